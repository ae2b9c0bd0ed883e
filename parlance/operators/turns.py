"""Turns and sessions: roles, timing, summaries, variants, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import rules, scores, text
from parlance.functions.rows import explode_rows
from parlance.operators.ordering import (
    BUCKET_ROWS, head_rows, head_tail_rows, prefix,
)

MASTER_COLUMNS = [
    "session_id", "language", "style", "turn_id", "start_time", "stop_time", "role",
    "role_label", "text_en", "text", "phq8_score", "phq8_binary", "severity", "gender", "split",
]
INDEX_COLUMNS = [
    "session_id", "phq8_score", "phq8_binary", "severity", "gender", "split", "n_turns",
    "n_patient_turns", "session_duration_sec",
]


def turn_bucket(order: str = "turn_id") -> Column:
    return F.floor(F.col(order) / BUCKET_ROWS)


def with_roles(turns: DataFrame, clinicians: list[str] = scores.CLINICIANS) -> DataFrame:
    return turns.withColumn("role", scores.role_of(F.col("speaker"), clinicians))


def with_metrics(turns: DataFrame) -> DataFrame:
    """Word count and duration; unreadable times count as zero, both of them."""
    start = F.col("start_time").try_cast("double")
    stop = F.col("stop_time").try_cast("double")
    bad = start.isNull() | stop.isNull()
    return (
        turns.withColumn("_a", F.when(bad, 0.0).otherwise(start))
        .withColumn("_b", F.when(bad, 0.0).otherwise(stop))
        .withColumn("start_time", F.bround("_a", 3))
        .withColumn("stop_time", F.bround("_b", 3))
        .withColumn("word_count", text.word_count(F.col("text_en")))
        .withColumn("duration_sec", scores.seconds_between(F.col("_a"), F.col("_b")))
        .drop("_a", "_b")
    )


def session_summary(turns: DataFrame) -> DataFrame:
    """Turn counts and the stop time of the last row, combined before the shuffle."""
    return turns.groupBy("session_id").agg(
        F.count("*").alias("n_turns"),
        F.count_if(F.col("role") == "Patient").alias("n_patient_turns"),
        F.bround(F.max_by("stop_time", "turn_id"), 3).alias("session_duration_sec"),
    )


def join_labels(sessions: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels are optional: severity and split read ``unknown`` without one."""
    joined = sessions.join(labels, "session_id", "left")
    return joined.withColumn("severity", scores.band(F.col("phq8_score"))).withColumn(
        "split", F.coalesce("split", F.lit("unknown"))
    )


def session_index(turns: DataFrame, labels: DataFrame) -> DataFrame:
    return join_labels(session_summary(turns), labels).select(*INDEX_COLUMNS)


def expand_variants(df: DataFrame, **choices: list[str]) -> DataFrame:
    """One copy of each row per combination of the given constant lists."""
    for name, values in choices.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def style_variants(turns: DataFrame, vocabulary: dict[str, dict[str, str]]) -> DataFrame:
    """Formal, colloquial and code-mixed text of each turn.

    ``text`` holds the translation supplied by the caller's model.
    """
    formal = rules.substitute_vocabulary(F.col("text"), vocabulary)
    variants = turns.withColumn("_formal", formal)
    said = {
        "formal_translated": F.col("_formal"),
        "colloquial": rules.to_slang(rules.to_spoken(F.col("_formal"))),
        "code_mixed": text.code_mix(F.col("text_en"), F.col("_formal"), rules.CODE_MIX_KEEP),
    }
    made = F.array(*[F.struct(F.lit(k).alias("style"), v.alias("t")) for k, v in said.items()])
    return (
        explode_rows(variants, [F.col(c) for c in variants.columns], made, "_v")
        .withColumn("style", F.col("_v.style"))
        .withColumn("text", F.col("_v.t"))
        .drop("_v", "_formal")
    )


def dialect_variants(turns: DataFrame, fillers: bool = False, seed: int = 42) -> DataFrame:
    """Every turn in every dialect; fillers are drawn from the turn's own key."""
    key = F.concat_ws("_", "session_id", "turn_id")
    said = {f"_said_{d}": rules.to_dialect(F.col("text"), d) for d in rules.DIALECTS}
    wide = turns.withColumns(said)
    made = []
    for name in rules.DIALECTS:
        one = F.col(f"_said_{name}")
        if fillers:
            one = rules.add_dialect_filler(one, F.col("role"), name, key, seed)
        made.append(F.struct(F.lit(name).alias("dialect"), one.alias("t")))
    return (
        explode_rows(wide, [F.col(c) for c in wide.columns], F.array(*made), "_v")
        .withColumn("dialect", F.col("_v.dialect"))
        .withColumn("text", F.col("_v.t"))
        .drop("_v", *said)
    )


def dialect_compare(turns: DataFrame, min_chars: int = 30) -> DataFrame:
    """Dialects side by side for patient turns whose standard text is long enough."""
    wide = [rules.to_dialect(F.col("text"), d).alias(d) for d in rules.DIALECTS]
    return turns.filter((F.col("role") == "Patient") & (F.length("text") > min_chars)).select(
        "session_id", "turn_id", *wide
    )


def spoken_style(turns: DataFrame, fillers: bool = False, seed: int = 42) -> DataFrame:
    """Spoken wording, slang, gendered verbs and optional fillers, in that order."""
    said = F.col("text")
    out = turns.withColumn("text", rules.to_slang(rules.to_spoken(said)))
    out = out.withColumn("text", rules.to_gender(said, F.col("role"), F.col("gender")))
    if not fillers:
        return out
    key = F.concat_ws("_", "session_id", "turn_id")
    chatty = rules.add_spoken_filler(said, F.col("role"), key, seed=seed)
    return out.withColumn("text", F.when(F.col("role") == "Patient", chatty).otherwise(said))


def master_rows(variants: DataFrame) -> DataFrame:
    return variants.withColumn(
        "role_label", rules.role_label(F.col("role"), F.col("language"))
    ).select(*MASTER_COLUMNS)


def variant_metadata(master: DataFrame) -> DataFrame:
    """One row per (session, language, style) with its labels and turn count."""
    return master.groupBy("session_id", "language", "style").agg(
        *[F.first(c).alias(c) for c in ("phq8_score", "phq8_binary", "severity", "gender", "split")],
        F.count("*").alias("n_turns"),
    )


def master_pages(master: DataFrame, page_rows: int = 1000) -> DataFrame:
    """Row lists per ``sid_lang_style`` key, in pages so that no list is unbounded."""
    key = F.concat_ws("_", "session_id", "language", "style")
    rest = [c for c in MASTER_COLUMNS if c != "turn_id"]
    return (
        master.withColumn("key", key)
        .withColumn("page", F.floor(F.col("turn_id") / page_rows))
        .groupBy("key", "page")
        .agg(F.sort_array(F.collect_list(F.struct("turn_id", *rest))).alias("rows"))
    )


def dataset_summary(master: DataFrame) -> DataFrame:
    """Per language, and in total: sessions, turns, patient turns."""
    per_session = master.groupBy("language", "session_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("role") == "Patient").alias("p")
    )
    return (
        per_session.rollup("language")
        .agg(
            F.count("*").alias("sessions"),
            F.sum("n").alias("total_turns"),
            F.sum("p").alias("patient_turns"),
        )
        .withColumn("language", F.coalesce("language", F.lit("all")))
    )


def head_tail_turns(turns: DataFrame, max_turns: int = 40) -> DataFrame:
    return head_tail_rows(turns, ["session_id"], "turn_id", max_turns)


def format_conversation(
    turns: DataFrame, max_turns: int = 40, english_first: bool = True
) -> DataFrame:
    """``role: text`` lines of at most ``max_turns`` turns per session."""
    first, second = ("text_en", "text") if english_first else ("text", "text_en")
    said = text.or_else(F.col(first), F.col(second))
    lines = head_tail_turns(turns, max_turns).select(
        "session_id", "turn_id",
        F.concat(F.coalesce("role", F.lit("Unknown")), F.lit(": "), said).alias("line"),
        said.alias("said"),
    )
    return (
        lines.groupBy("session_id")
        .agg(
            F.sort_array(
                F.collect_list(F.when(F.col("said") != "", F.struct("turn_id", "line")))
            ).alias("lines")
        )
        .select(
            "session_id",
            F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("conversation"),
        )
    )


def first_turns_language(turns: DataFrame, n: int = 10) -> DataFrame:
    """Language of the first ``n`` turns of each session, read as one text."""
    head = head_rows(turns.select("session_id", "turn_id", "text"), ["session_id"],
                     [F.col("turn_id")], n)
    return (
        head.groupBy("session_id")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("turn_id", F.coalesce("text", F.lit("")).alias("t")))
            ).alias("s")
        )
        .select(
            "session_id",
            text.detect_language(F.array_join(F.transform("s", lambda x: x["t"]), " "))
            .alias("language"),
        )
    )


def has_english(turns: DataFrame, n: int = 5) -> DataFrame:
    """Whether any of the first ``n`` turns carries English, which picks the route."""
    head = head_rows(turns.select("session_id", "turn_id", "text_en"), ["session_id"],
                     [F.col("turn_id")], n)
    return (
        head.groupBy("session_id")
        .agg(F.bool_or(~text.is_blank(F.col("text_en"))).alias("has_english"))
        .withColumn("route", F.when(F.col("has_english"), "bilingual").otherwise("native"))
    )


def turn_preview(turns: DataFrame, n: int = 10, width: int = 100) -> DataFrame:
    head = head_rows(turns, ["session_id"], [F.col("turn_id")], n)
    return head.select(
        "session_id", "turn_id",
        F.when(F.col("role") == "Doctor", "Clinician").otherwise("Patient").alias("who"),
        text.preview(F.col("text_en"), width).alias("preview"),
    )


def timed_by_words(turns: DataFrame, seconds_per_word: float = 0.4) -> DataFrame:
    """Start and stop times from running word counts, for turns that carry no times."""
    counted = turns.withColumn("_w", text.word_count(F.col("text_en")).cast("long"))
    timed = prefix(
        counted, ["session_id"], ["turn_id"], turn_bucket(), running_sum={"_cum": F.col("_w")}
    )
    return (
        timed.withColumn(
            "start_time", F.bround((F.col("_cum") - F.col("_w")) * seconds_per_word, 3)
        )
        .withColumn("stop_time", F.bround(F.col("_cum") * seconds_per_word, 3))
        .drop("_w", "_cum")
    )


def skip_existing(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return jobs.join(done.select(*keys), keys, "left_anti")


def apply_model(df: DataFrame, fn=None, schema=None) -> DataFrame:
    """Run a user's batch model over Arrow batches; without one, pass rows through.

    ``fn`` takes an iterator of pandas frames and yields frames of ``schema``, so a
    model is loaded once per Python worker.
    """
    return df if fn is None else df.mapInPandas(fn, schema)
