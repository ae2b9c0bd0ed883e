"""Queries for windows, ordering, splits, waveforms and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import scores, text
from parlance.functions.rows import explode_rows, inline_rows
from parlance.operators import clinic, evaluation as V, review as R
from parlance.operators import speakers as S, splits as P, turns as T, waves as W
from parlance.plans import tables as B
from parlance.plans.registry import query
from parlance.plans.set_queries import BAGS, E_LEN, EXPECT, RATIO, SHORT, SQL_EDIT
from parlance.plans.tables import quote
from parlance.plans.text_queries import DETECT, KEY, SQL_BRIEF, SQL_QUESTION
from parlance.session import scratch
from parlance.streaming import jobs

SHORT_TURNS = 4


@query("head_tail_turns", f"""WITH {B.TALK} SELECT {KEY}, role FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_id) AS rn,
  count(*) OVER (PARTITION BY session_id) AS n FROM talk) WHERE n <= {SHORT_TURNS} OR rn <= {SHORT_TURNS // 2} OR rn > n - {SHORT_TURNS // 2}""")
def head_tail_turns(spark, sf):
    return T.head_tail_turns(B.talk(spark, sf).select("session_id", "turn_id", "role"), SHORT_TURNS)


@query("format_conversation", f"""WITH {B.TALK}, h AS (SELECT session_id, turn_id, role, coalesce(nullif(CASE WHEN turn_id % 2 = 0 THEN '' ELSE en END, ''), raw) AS said,
    row_number() OVER (PARTITION BY session_id ORDER BY turn_id) AS rn, count(*) OVER (PARTITION BY session_id) AS n FROM talk)
  SELECT session_id, string_agg(role || ': ' || said, chr(10) ORDER BY turn_id) AS conversation FROM h
  WHERE said <> '' AND (n <= {SHORT_TURNS} OR rn <= {SHORT_TURNS // 2} OR rn > n - {SHORT_TURNS // 2}) GROUP BY session_id""")
def format_conversation(spark, sf):
    t = B.talk(spark, sf).select(
        "session_id", "turn_id", "role", F.col("raw").alias("text"),
        F.when(F.col("turn_id") % 2 == 0, "").otherwise(F.col("en")).alias("text_en"),
    )
    return T.format_conversation(t, SHORT_TURNS)


@query("first_turns_language", f"""WITH {B.TALK}, h AS (SELECT session_id, turn_id, CASE session_id % 3 WHEN 0 THEN mr WHEN 1 THEN raw ELSE mr || ' ' || raw END AS t FROM talk
    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn_id) <= 10),
  j AS (SELECT session_id, string_agg(t, ' ' ORDER BY turn_id) AS x FROM h GROUP BY session_id)
  SELECT session_id, {DETECT.format('x')} AS language FROM j""")
def first_turns_language(spark, sf):
    k = F.col("session_id") % 3
    said = F.when(k == 0, F.col("mr")).when(k == 1, F.col("raw")).otherwise(F.concat("mr", F.lit(" "), "raw"))
    return T.first_turns_language(B.talk(spark, sf).withColumn("text", said))


@query("has_english", f"""WITH {B.TALK}, h AS (SELECT session_id, CASE WHEN session_id % 3 = 0 OR turn_id < 5 AND session_id % 3 = 1 THEN '  ' ELSE raw END AS e FROM talk
    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn_id) <= 5)
  SELECT session_id, bool_or(trim(e) <> '') AS has_english, CASE WHEN bool_or(trim(e) <> '') THEN 'bilingual' ELSE 'native' END AS route FROM h GROUP BY session_id""")
def has_english(spark, sf):
    k = F.col("session_id") % 3
    said = F.when((k == 0) | ((F.col("turn_id") < 5) & (k == 1)), "  ").otherwise(F.col("raw"))
    return T.has_english(B.talk(spark, sf).withColumn("text_en", said))


# Sessions whose id divides by 5 get no pause at all, so that cues decide there.
HINTS = f"""{B.CHUNKS}, tight AS (SELECT session_id, chunk_id, CASE WHEN session_id % 5 = 0 THEN 1e9 ELSE end_s END AS end_s, start_s, text,
    row_number() OVER (PARTITION BY session_id ORDER BY chunk_id) - 1 AS i FROM chunks),
  pz AS (SELECT *, coalesce(start_s - lag(end_s) OVER w > 1.5, false) AS gap, coalesce(lag({SQL_QUESTION.format('lower(text)')}) OVER w, false) AND {SQL_BRIEF.format('lower(text)')} AS cue FROM tight WINDOW w AS (PARTITION BY session_id ORDER BY chunk_id)),
  fx AS (SELECT *, min(CASE WHEN i >= 1 AND (cue OR i % 2 = 0) THEN i END) OVER (PARTITION BY session_id) AS firstflip FROM pz),
  fl AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER w AS g, sum(CASE WHEN cue OR i = firstflip THEN 1 ELSE 0 END) OVER w AS c FROM fx WINDOW w AS (PARTITION BY session_id ORDER BY chunk_id ROWS UNBOUNDED PRECEDING)),
  hs AS (SELECT *, CASE WHEN g % 2 = 0 THEN 'A' ELSE 'B' END AS by_pause, CASE WHEN c % 2 = 0 THEN 'A' ELSE 'B' END AS by_cue FROM fl)"""


def _tight(spark, sf):
    return B.chunks(spark, sf).select(
        "session_id", "chunk_id", "start_s",
        F.when(F.col("session_id") % 5 == 0, 1e9).otherwise(F.col("end_s")).alias("end_s"), "text",
    )


@query("speaker_by_pause", f"WITH {HINTS} SELECT session_id, chunk_id, by_pause AS speaker FROM hs")
def speaker_by_pause(spark, sf):
    return S.speaker_by_pause(_tight(spark, sf)).select("session_id", "chunk_id", "speaker")


@query("speaker_by_cue", f"WITH {HINTS} SELECT session_id, chunk_id, by_cue AS speaker FROM hs")
def speaker_by_cue(spark, sf):
    return S.speaker_by_cue(_tight(spark, sf)).select("session_id", "chunk_id", "speaker")


REBALANCE = """bal AS (SELECT *, greatest(count(*) FILTER (WHERE speaker = 'A') OVER p, count(*) FILTER (WHERE speaker = 'B') OVER p) AS top, count(*) OVER p AS n FROM {0} WINDOW p AS (PARTITION BY session_id)),
  out AS (SELECT session_id, chunk_id, CASE WHEN n >= 6 AND top / n >= 0.85 THEN CASE WHEN i % 2 = 0 THEN 'A' ELSE 'B' END ELSE speaker END AS speaker FROM bal)"""


@query("speaker_rebalance", f"""WITH {B.CHUNKS}, sp AS (SELECT *, CASE WHEN session_id % 2 = 0 THEN CASE WHEN chunk_id % 20 = 0 THEN 'B' ELSE 'A' END ELSE CASE WHEN chunk_id % 3 = 0 THEN 'B' ELSE 'A' END END AS who,
    row_number() OVER (PARTITION BY session_id ORDER BY chunk_id) - 1 AS i FROM chunks), named AS (SELECT session_id, chunk_id, who AS speaker, i FROM sp), {REBALANCE.format('named')} SELECT * FROM out""")
def speaker_rebalance(spark, sf):
    every = F.when(F.col("session_id") % 2 == 0, 20).otherwise(3)
    c = B.chunks(spark, sf).withColumn(
        "speaker", F.when(F.col("chunk_id") % every == 0, "B").otherwise("A")
    )
    return S.speaker_rebalance(c.select("session_id", "chunk_id", "speaker"))


@query("speaker_hints", f"""WITH {HINTS}, named AS (SELECT session_id, chunk_id, i, CASE WHEN bool_or(by_pause = 'B') OVER (PARTITION BY session_id) THEN by_pause ELSE by_cue END AS speaker FROM hs),
  {REBALANCE.format('named')} SELECT * FROM out""")
def speaker_hints(spark, sf):
    return S.speaker_hints(_tight(spark, sf)).select("session_id", "chunk_id", "speaker")


@query("token_runs", """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '([\\p{L}\\p{N}_'']+)', 1) AS w FROM documents),
  e AS (SELECT doc_id, unnest(w) AS tok, generate_subscripts(w, 1) AS i FROM t),
  b AS (SELECT *, CASE WHEN tok = lag(tok) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS brk FROM e),
  g AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b)
  SELECT doc_id, CAST(coalesce(max(c), 0) AS INTEGER) AS longest FROM documents LEFT JOIN (SELECT doc_id, run, count(*) AS c FROM g GROUP BY ALL) USING (doc_id) GROUP BY doc_id""")
def token_runs(spark, sf):
    return B.read(spark, sf, "documents").select(
        "doc_id", text.longest_run(text.spoken_tokens(F.col("text"))).alias("longest")
    )


@query("worst_k", f"""WITH RECURSIVE {B.PAIRS}, {BAGS}, {SQL_EDIT}, e AS (SELECT {KEY}, round(100.0::DOUBLE * word_edits / greatest(ref_words, 1), 6) AS sample_error FROM wd)
  SELECT * FROM e ORDER BY sample_error DESC, session_id, turn_id LIMIT 20""")
def worst_k(spark, sf):
    """By word error, as the samples to look at are chosen."""
    e = V.word_errors(B.pairs(spark, sf))
    scored = e.select(
        "session_id", "turn_id",
        F.round(100.0 * F.col("word_edits") / F.greatest("ref_words", F.lit(1)), 6).alias("sample_error"),
    )
    return V.worst_k(scored, "sample_error", ["session_id", "turn_id"])


@query("recent_visits", f"WITH {B.PATIENTS}, {B.VISITS} SELECT visit_id, patient_id, full_name AS patient_name FROM visits JOIN patients ON id = patient_id ORDER BY visits.created_at DESC, visit_id LIMIT 100")
def recent_visits(spark, sf):
    return clinic.recent_visits(B.visits(spark, sf), B.patients(spark, sf)).select("visit_id", "patient_id", "patient_name")


@query("search_patients", f"""WITH {B.PATIENTS}, {B.VISITS} SELECT p.*, (SELECT count(*) FROM visits v WHERE v.patient_id = p.id) AS session_count FROM patients p
  WHERE full_name ILIKE '%cust_mer#%7%' ORDER BY created_at DESC, id LIMIT 50""")
def search_patients(spark, sf):
    return clinic.search_patients(B.patients(spark, sf), B.visits(spark, sf), " cust_mer#%7 ")


@query("json_payload_decode", """SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM events""")
def json_payload_decode(spark, sf):
    raw = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{broken "), "props")).when(
        F.col("event_id") % 5 == 1, F.concat(F.lit("["), "props")
    ).otherwise(F.col("props"))
    return B.read(spark, sf, "events").select(
        "event_id", clinic.decode_payload(raw, "struct<k:int>")["k"].alias("k")
    )


@query("format_transcript", f"""WITH {B.CHUNKS}, p AS (SELECT *, lag(speaker) OVER (PARTITION BY session_id ORDER BY chunk_id) AS prev FROM chunks)
  SELECT session_id, chunk_id, CASE WHEN speaker IS DISTINCT FROM prev THEN chr(10) || repeat('─', 55) || chr(10) || 'Speaker ' || speaker || ':' END AS heading,
    '  ' || printf('[%02d:%02d]', CAST(floor(start_s / 60) AS BIGINT), CAST(floor(start_s % 60) AS BIGINT)) || '  ' || text AS line FROM p""")
def format_transcript(spark, sf):
    return S.format_transcript(B.chunks(spark, sf))


@query("segment_lines", f"WITH {B.TALK}, {B.TIMED} SELECT session_id, turn_id AS chunk_id, printf('[%6.2fs - %6.2fs] %s: %s', start_time, stop_time, speaker, text_en) AS line FROM timed")
def segment_lines(spark, sf):
    t = B.timed(spark, sf).select(
        "session_id", F.col("turn_id").alias("chunk_id"), F.col("start_time").alias("start_s"),
        F.col("stop_time").alias("end_s"), "speaker", F.col("text_en").alias("text"),
    )
    return S.segment_lines(t)


def sql_hash(key: str, seed: str) -> str:
    return f"md5(CAST({key} AS VARCHAR) || ':{seed}')"


@query("split_three_way", f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {sql_hash('doc_id', '42')}, doc_id) - 1 AS rk, count(*) OVER () AS n FROM documents)
  SELECT doc_id, CASE WHEN rk < floor(n * 0.8) THEN 'train' WHEN rk < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM r""")
def split_three_way(spark, sf):
    return P.split_three_way(B.read(spark, sf, "documents").select("doc_id"), "doc_id")


@query("split_two_way", f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {sql_hash('doc_id', '42')}, doc_id) - 1 AS rk, count(*) OVER () AS n FROM labels)
  SELECT doc_id, CASE WHEN rk < floor(n * 0.8) THEN 'train' ELSE 'val' END AS split FROM r""")
def split_two_way(spark, sf):
    return P.split_two_way(B.read(spark, sf, "labels").select("doc_id"), "doc_id")


@query("split_sequential", """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rk, count(*) OVER () AS n FROM documents)
  SELECT doc_id, CASE WHEN rk < floor(n * 0.8) THEN 'train' ELSE 'val' END AS split FROM r""")
def split_sequential(spark, sf):
    d = B.read(spark, sf, "documents").select("doc_id")
    return P.split_sequential(d, "doc_id")


EXAMPLES = f"""ex AS (SELECT {KEY}, raw AS prompt, 'Subjective: ' || en || ' objective ' || CASE WHEN turn_id % 2 = 0 THEN 'assessment' ELSE '' END || ' Plan' AS response FROM talk)"""


def _examples(spark, sf):
    return B.talk(spark, sf).select(
        "session_id", "turn_id", F.col("raw").alias("prompt"),
        F.concat(F.lit("Subjective: "), "en", F.lit(" objective "),
                 F.when(F.col("turn_id") % 2 == 0, "assessment").otherwise(""), F.lit(" Plan")).alias("response"),
    )


@query("quality_filter", f"""WITH {B.TALK}, {EXAMPLES} SELECT {KEY} FROM ex WHERE length(prompt) >= 200 AND length(response) >= 500
  AND {' AND '.join(f"contains(upper(response), '{w}')" for w in P.SECTION_WORDS)}""")
def quality_filter(spark, sf):
    return P.quality_filter(_examples(spark, sf)).select("session_id", "turn_id")


NOTE_KEY = "session_id || '_' || turn_id"
STRATUM = B.sql_band("phq8_score", scores.STRATA)
SAMPLE = f"""sample AS (SELECT {KEY}, phq8_score, {STRATUM} AS stratum FROM notes QUALIFY row_number() OVER (PARTITION BY {STRATUM} ORDER BY {sql_hash(NOTE_KEY, '42')}) <= 3)"""
EDGES = f"""tot AS (SELECT {KEY}, phq8_score, CAST({' + '.join(E_LEN)} AS INTEGER) AS total_length FROM notes),
  edges AS (SELECT *, 'high_severity' AS reason FROM tot WHERE phq8_score >= 20 UNION ALL SELECT *, 'too_short' FROM tot WHERE total_length < 500 UNION ALL SELECT *, 'too_long' FROM tot WHERE total_length > 3000)"""


def _sample(notes):
    return R.stratified_sample(notes, F.concat_ws("_", "session_id", "turn_id"))


@query("stratified_sample", f"WITH {B.TALK}, {B.NOTES}, {SAMPLE} SELECT * FROM sample")
def stratified_sample(spark, sf):
    return _sample(B.notes(spark, sf)).select("session_id", "turn_id", "phq8_score", "stratum")


@query("edge_cases", f"WITH {B.TALK}, {B.NOTES}, {EDGES} SELECT * FROM edges")
def edge_cases(spark, sf):
    return R.edge_cases(B.notes(spark, sf), ["session_id", "turn_id"])


ISSUES = f"""{SHORT}, issues AS (SELECT {KEY}, upper(left(language, 1)) || substr(language, 2) || ' ' || section || ' too short (' || n_chars || ' chars)' AS issue FROM short
  UNION ALL SELECT {KEY}, 'too many English characters' FROM notes WHERE {RATIO} > 0.3
  UNION ALL SELECT {KEY}, 'Assessment doesn''t mention severity level (PHQ-8: ' || phq8_score || ')' FROM notes WHERE NOT contains(lower(e_assessment), {EXPECT}))"""


@query("note_issues", f"WITH {B.TALK}, {B.NOTES}, {ISSUES} SELECT * FROM issues")
def note_issues(spark, sf):
    return R.note_issues(B.notes(spark, sf), ["session_id", "turn_id"])


@query("review_list", f"""WITH {B.TALK}, {B.NOTES}, {SAMPLE}, {EDGES}, {ISSUES}
  SELECT {KEY} FROM sample UNION (SELECT {KEY} FROM edges ORDER BY {KEY} LIMIT 5) UNION (SELECT DISTINCT {KEY} FROM issues ORDER BY {KEY} LIMIT 5)""")
def review_list(spark, sf):
    n, key = B.notes(spark, sf), ["session_id", "turn_id"]
    return R.review_list(_sample(n), R.edge_cases(n, key), R.note_issues(n, key), key)


AUG = ", ".join(quote(n) for n in P.AUGMENTATIONS)


def sql_amount(key: str, name: str) -> str:
    digest = f"md5({key} || ':' || {name} || ':amount42')"
    share = "(" + " + ".join(
        f"(strpos('0123456789abcdef', substr({digest}, {i + 1}, 1)) - 1) * {16 ** (5 - i)}" for i in range(6)
    ) + ")::DOUBLE"
    arms = ""
    for n, (low, high) in P.DRAWS.items():
        value = f"{low}::DOUBLE + {share} / {16.0 ** 6}::DOUBLE * {high - low!r}::DOUBLE"
        arms += f" WHEN {quote(n)} THEN " + (f"round({value}, 2)" if n.startswith("speed") else value)
    return f"CASE {name}{arms} END"


@query("augmentation_plan", f"""WITH c AS (SELECT doc_id, 'clip' || doc_id || '.wav' AS file_name, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM documents),
  a AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY md5(doc_id || ':' || n || ':42')) AS rn FROM c, (SELECT unnest([{AUG}]) AS n) WHERE split = 'train')
  SELECT doc_id, split, file_name, NULL AS augmented, NULL::DOUBLE AS amount FROM c UNION ALL SELECT doc_id, split, 'clip' || doc_id || '_' || n || '.wav', n, round({sql_amount('doc_id', 'n')}, 6) FROM c JOIN a USING (doc_id) WHERE rn <= 3""")
def augmentation_plan(spark, sf):
    k = F.col("doc_id") % 10
    clips = B.read(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("clip"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("file_name"),
        F.when(k < 8, "train").when(k == 8, "val").otherwise("test").alias("split"),
    )
    return P.augmentation_plan(clips, "doc_id").withColumn("amount", F.round("amount", 6))


def _sql_resampled(wave: str, m: str) -> str:
    """Linear interpolation of a list onto ``m`` points from its first to its last value."""
    at = f"(CASE WHEN {m} > 1 THEN i * (len({wave}) - 1) / ({m} - 1)::DOUBLE ELSE 0 END)"
    lo = f"least(floor({at})::BIGINT, len({wave}) - 1)"
    low, high = f"{wave}[{lo} + 1]", f"{wave}[least({lo} + 1, len({wave}) - 1) + 1]"
    return f"list_transform(range(({m})::BIGINT), lambda i: {low} + ({high} - {low}) * ({at} - {lo}))"


@query("augmented_waves", f"""WITH c AS (SELECT vec_id, embedding::DOUBLE[] AS wave FROM embeddings),
  a AS (SELECT vec_id, wave, n, {sql_amount('vec_id', 'n')} AS amount, row_number() OVER (PARTITION BY vec_id ORDER BY md5(vec_id || ':' || n || ':42')) AS rn FROM c, (SELECT unnest([{AUG}]) AS n)),
  v AS (SELECT * FROM a WHERE rn <= 3 UNION ALL SELECT vec_id, wave, NULL, NULL, 0 FROM c),
  m AS (SELECT *, floor(len(wave) / amount) AS fast, floor(len(wave) * pow(2.0::DOUBLE, -amount / 12)) AS bent FROM v),
  p AS (SELECT *, CASE WHEN n LIKE 'pitch%' THEN {_sql_resampled('wave', 'bent')} END AS shifted FROM m),
  x AS (SELECT vec_id, n, wave, fast, CASE WHEN n LIKE 'speed%' THEN {_sql_resampled('wave', 'fast')}
      WHEN n LIKE 'pitch%' THEN {_sql_resampled('shifted', 'len(wave)')}
      WHEN n LIKE 'volume%' THEN list_transform(wave, lambda x: greatest(-1.0, least(1.0, x * pow(10.0::DOUBLE, amount / 20.0::DOUBLE))))
      WHEN n IS NULL THEN wave END AS made FROM p)
  SELECT vec_id, n AS augmented, CAST(CASE WHEN n LIKE 'speed%' THEN fast ELSE len(wave) END AS INTEGER) AS samples,
    round(list_sum(list_transform(made, lambda x: x::FLOAT::DOUBLE)), 4) AS total FROM x""")
def augmented_waves(spark, sf):
    """Plan and application: lengths of all variants, sums of all but the noisy ones."""
    clips = B.read(spark, sf, "embeddings").select(
        "vec_id", "embedding", F.concat(F.col("vec_id").cast("string"), F.lit(".wav")).alias("file_name"), F.lit("train").alias("split")
    )
    plan = P.augmentation_plan(clips, "vec_id").withColumn("clip", F.concat_ws("_", "vec_id", "augmented"))
    waves = W.augment(plan, "clip", "embedding").select("clip", F.col("embedding").alias("wave"))
    total = F.round(F.aggregate("wave", F.lit(0.0), lambda s, x: s + x.cast("double")), 4)
    noisy = F.coalesce(F.col("augmented").startswith("noise"), F.lit(False))
    return plan.join(waves, "clip").select(
        "vec_id", "augmented", F.size("wave").alias("samples"), F.when(~noisy, total).alias("total")
    )


SAMPLES = "SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, {0} AS x FROM (SELECT *, unnest(range(1, len(wave) + 1)) AS i FROM {1})"
WAVES = "wv AS (SELECT vec_id, embedding::DOUBLE[] AS wave FROM embeddings)"


def _spread(df, wave):
    return explode_rows(df, ["vec_id"], wave, "_x", "i").select("vec_id", "i", F.round("_x", 6).alias("x"))


@query("peak_normalise", f"WITH {WAVES}, pk AS (SELECT *, list_max(list_transform(wave, lambda v: abs(v))) AS m FROM wv) " + SAMPLES.format("round(CASE WHEN m > 0 THEN wave[i] / m * 0.95::DOUBLE ELSE wave[i] END, 6)", "pk"))
def peak_normalise(spark, sf):
    return _spread(B.read(spark, sf, "embeddings"), W.peak_normalise(F.col("embedding")))


@query("duration_filter", """WITH c AS (SELECT vec_id, len(embedding) * (vec_id % 4) / 16.0::DOUBLE AS duration_s FROM embeddings)
  SELECT vec_id, duration_s, CASE WHEN duration_s < 1 THEN 'too_short' WHEN duration_s > 5 THEN 'too_long' ELSE 'kept' END AS outcome FROM c""")
def duration_filter(spark, sf):
    """Each whole waveform no time, once, twice or three times over."""
    wave = F.flatten(F.array_repeat("embedding", (F.col("vec_id") % 4).cast("int")))
    e = B.read(spark, sf, "embeddings").select("vec_id", W.duration_s(wave, 16).alias("duration_s"))
    reason = W.skip_reason(F.lit("spoken"), F.lit(True), F.col("duration_s"), 1.0, 5.0)
    return e.withColumn("outcome", F.coalesce(reason, F.lit("kept")))


@query("gain_clip", f"WITH {WAVES} " + SAMPLES.format("round(greatest(-1.0, least(1.0, wave[i] * pow(10.0::DOUBLE, 12 / 20.0::DOUBLE))), 6)", "wv"))
def gain_clip(spark, sf):
    return _spread(B.read(spark, sf, "embeddings"), W.gain_clip(F.col("embedding"), 12))


def sql_resample(source: str, out: str, m: str, wave: str = "wave", extra: str = "") -> str:
    """CTE ``out`` with ``wave`` resampled to ``m`` points."""
    pos = f"(CASE WHEN ({m}) > 1 THEN (i - 1) * (len({wave}) - 1)::DOUBLE / (({m}) - 1) ELSE 0.0::DOUBLE END)"
    lo, hi = f"floor({pos})::BIGINT", f"least(floor({pos})::BIGINT + 1, len({wave}) - 1)"
    return (f"{out} AS (SELECT vec_id{extra}, list_transform(range(1, ({m}) + 1), lambda i: {wave}[{lo} + 1] + ({wave}[{hi} + 1] - {wave}[{lo} + 1]) * ({pos} - {lo})) AS wave FROM {source})")


PITCH_FACTOR = repr(2 ** (-1.5 / 12))


@query("resample_speed_pitch", f"""WITH {WAVES}, {sql_resample('wv', 'slow', 'floor(len(wave) / 0.85::DOUBLE)::BIGINT')}, {sql_resample('wv', 'rate', 'floor(len(wave) * 16000 / 44100.0::DOUBLE)::BIGINT')},
  {sql_resample('wv', 'p1', f'floor(len(wave) * {PITCH_FACTOR}::DOUBLE)::BIGINT')}, {sql_resample('p1', 'pitch', '64')},
  every AS (SELECT vec_id, 'speed' AS kind, wave FROM slow UNION ALL SELECT vec_id, 'rate', wave FROM rate UNION ALL SELECT vec_id, 'pitch', wave FROM pitch)
  SELECT vec_id, kind, CAST(i - 1 AS INTEGER) AS i, round(wave[i], 6) AS x FROM (SELECT *, unnest(range(1, len(wave) + 1)) AS i FROM every)""")
def resample_speed_pitch(spark, sf):
    e, w = B.read(spark, sf, "embeddings"), F.col("embedding")
    kinds = F.array(
        F.struct(F.lit("speed").alias("kind"), W.change_speed(w, 0.85).alias("wave")),
        F.struct(F.lit("rate").alias("kind"), W.change_rate(w, 44100).alias("wave")),
        F.struct(F.lit("pitch").alias("kind"), W.shift_pitch(w, 1.5).alias("wave")),
    )
    made = inline_rows(e, ["vec_id"], kinds)
    return explode_rows(made, ["vec_id", "kind"], F.col("wave"), "x", "i").withColumn("x", F.round("x", 6))


@query("noise_snr", """SELECT vec_id, CAST(len(embedding) AS INTEGER) AS samples, true AS changed, true AS near_snr FROM embeddings""")
def noise_snr(spark, sf):
    """Each clip's noise against what was asked for, 20 dB: within 5 dB over its few samples."""
    e = B.read(spark, sf, "embeddings").select("vec_id", "embedding")
    noisy = W.add_noise(e, "vec_id", "embedding", 20.0).withColumnRenamed("embedding", "noisy")
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    added = F.zip_with("noisy", "embedding", lambda a, b: a - b)
    snr = 10 * F.log10(square(F.col("embedding")) / square(added))
    return e.join(noisy, "vec_id").select(
        "vec_id", F.size("noisy").alias("samples"), (square(added) > 0).alias("changed"),
        snr.between(15.0, 25.0).alias("near_snr"),
    )


@query("overlap_windows", """WITH s AS (SELECT vec_id, embedding, unnest(range(0, 64, 12)) AS lo FROM embeddings), w AS (SELECT vec_id, CAST(lo // 12 AS INTEGER) AS chunk_id, lo, list_slice(embedding, lo + 1, lo + 16) AS x FROM s)
  SELECT vec_id, chunk_id, lo / 16.0::DOUBLE AS start_s, (lo + len(x)) / 16.0::DOUBLE AS end_s, CAST(len(x) AS INTEGER) AS n, round(list_sum(x::DOUBLE[]), 6) AS total FROM w WHERE len(x) / 16.0 >= 0.5""")
def overlap_windows(spark, sf):
    e = B.read(spark, sf, "embeddings").select("vec_id", "embedding")
    cut = W.windows(e, "vec_id", "embedding", rate=16, window_s=1, overlap_s=0.25)
    total = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return cut.select("vec_id", "chunk_id", "start_s", "end_s", F.size("samples").alias("n"), F.round(total, 6).alias("total"))


def _stream(spark, sf, columns):
    schema = B.read(spark, sf, "events").schema
    return jobs.read_files(spark, sf, schema, "events.parquet").select(*columns)


@query("stream_ingest_sessions", "SELECT event_id, user_id, epoch_us(ts) AS at FROM events")
def stream_ingest_sessions(spark, sf):
    """Three batches: new keys, then later ones with old keys again, then the earliest, late."""
    e = B.read(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    src, out = scratch(spark, "ingest-files"), scratch(spark, "ingest")
    part = F.col("event_id") % 3
    again = e.withColumn("ts", F.col("ts") + F.expr("interval 2 days"))
    first, later, late = (e.filter(part == k) for k in (1, 2, 0))
    state = scratch(spark, "ingest-state")
    for batch in (first, later.unionByName(again.filter(part == 1)), late.unionByName(again.filter(part != 0))):
        batch.write.mode("append").parquet(src)
        jobs.ingest(jobs.read_files(spark, src, e.schema), ["event_id"], "ts", out, state).awaitTermination()
    got = spark.read.schema("event_id long, user_id long, ts timestamp").parquet(out)
    return got.select("event_id", "user_id", F.unix_micros("ts").alias("at"))


@query("stream_progress", "SELECT event_type, count(*) AS done FROM events GROUP BY event_type")
def stream_progress(spark, sf):
    out = scratch(spark, "progress")
    jobs.progress(_stream(spark, sf, ["event_type"]), "event_type", out, scratch(spark, "progress-state")).awaitTermination()
    return jobs.newest(spark, out)


@query("stream_active_visits", """WITH d AS (SELECT unnest(generate_series(0, 6)) AS k), w AS (SELECT epoch_us(date_trunc('day', ts))::BIGINT - k * 86400000000 AS lo FROM events, d)
  SELECT lo AS window_start, lo + 7 * 86400000000 AS window_end, count(*) AS visits FROM w WHERE lo IS NOT NULL GROUP BY lo""")
def stream_active_visits(spark, sf):
    """Two runs over one folder; the second brings the earlier half, days late."""
    e = B.read(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    src, out, state = (scratch(spark, n) for n in ("active-files", "active", "active-state"))
    early = F.dayofmonth("ts") <= 15
    for half in (e.filter(~early), e.filter(early | early.isNull())):
        half.write.mode("append").parquet(src)
        jobs.daily_visits(jobs.read_files(spark, src, e.schema), "ts", out, state).awaitTermination()
    got = jobs.active_visits(spark, out)
    return got.select(
        F.unix_micros("window_start").alias("window_start"), F.unix_micros("window_end").alias("window_end"), "visits"
    )
