"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from parlance.session import local_session  # noqa: E402

HEADLINE = [
    "sessions_index", "text_normalise", "detect_language", "dialect_rewrite", "colloquial_rewrite",
    "simplify_english", "code_mix", "prepare_conversation", "split_sections_simple",
    "split_sections_robust", "sanitise_section", "chunk_text", "collapse_loops", "keyword_entities",
    "regex_entities", "entity_by_side", "assign_speakers", "speaker_hints", "role_from_speaker",
    "phrase_terms", "term_topk", "eval_report", "corpus_cer", "corpus_wer", "note_metric_summary",
    "split_three_way", "overlap_windows", "peak_normalise", "patient_visit_count", "recent_visits",
    "stream_active_visits",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")

    from parlance.plans import catalog

    if names == ["all"]:
        names = list(catalog.QUERIES)
    # The first query runs once unmeasured, so that it does not pay for a cold session.
    catalog.QUERIES[names[0]](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name:26s} {times[name]:8.2f}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_wall_clock", "value": total, "unit": "sec", "queries": times,
                      "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
