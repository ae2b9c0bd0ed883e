"""Queries for sources and sinks: each writes derived files and reads them back."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from parlance.functions import rules, scores
from parlance.operators import splits as P, turns as T
from parlance.plans import tables as B
from parlance.plans.order_queries import EXAMPLES, _examples, sql_hash
from parlance.plans.registry import query
from parlance.plans.text_queries import sql_replace
from parlance.session import scratch
from parlance.sources import documents as D, sinks as K, transcripts as X


@query("scan_transcripts", f"""WITH {B.TALK}, {B.TIMED} SELECT session_id, turn_id, speaker, role, {B.sql_strip('text_en')} AS text_en, start_time, stop_time, CAST(w AS INTEGER) AS word_count, round(greatest(stop_time - start_time, 0), 3) AS duration_sec FROM timed""")
def scan_transcripts(spark, sf):
    """Tab-separated files for even sessions, comma-separated ones for odd, one scan over both."""
    root = scratch(spark, "transcripts")
    t = B.timed(spark, sf).select(
        F.col("session_id").alias("sid"), "start_time", "stop_time", "speaker", F.col("text_en").alias("value"), "turn_id"
    ).repartition("sid").sortWithinPartitions("sid", "turn_id").drop("turn_id")
    for name, sep, rest in (("tab", "\t", 0), ("comma", ",", 1)):
        t.filter(F.col("sid") % 2 == rest).write.partitionBy("sid").options(sep=sep, **K.CSV).csv(f"{root}/{name}")
    sid = F.regexp_extract("_file", r"sid=(\d+)", 1).try_cast("long")
    return X.scan_transcripts(spark, root, None, B.CLINICIANS, sid, "*.csv")


@query("session_id_from_path", """WITH p AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'raw/' || doc_id || '_P/' || doc_id || '_TRANSCRIPT.csv' WHEN 1 THEN 'raw/' || source || '_' || doc_id || '.csv' ELSE 'x/' || doc_id || '.json' END AS path FROM documents)
  SELECT doc_id, path, CASE WHEN doc_id % 3 <> 1 THEN doc_id END AS session_id FROM p""")
def session_id_from_path(spark, sf):
    k = F.col("doc_id").cast("string")
    path = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("raw/"), k, F.lit("_P/"), k, F.lit("_TRANSCRIPT.csv")))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("raw/"), "source", F.lit("_"), k, F.lit(".csv")))
        .otherwise(F.concat(F.lit("x/"), k, F.lit(".json")))
    )
    return B.read(spark, sf, "documents").select("doc_id", path.alias("path")).select(
        "doc_id", "path", scores.session_id_from_path(F.col("path")).alias("session_id")
    )


LABEL_FILES = """f AS (SELECT doc_id, quality, toxic, r FROM labels, (VALUES (0), (1), (2)) v(r) WHERE r = 0 OR doc_id % (r + 1) = 0),
  w AS (SELECT doc_id AS session_id, max(r) AS r FROM f GROUP BY doc_id)"""


@query("scan_labels", f"""WITH {LABEL_FILES} SELECT session_id, CASE WHEN session_id % 5 = 0 THEN NULL ELSE CAST(session_id % 25 AS INTEGER) END AS phq8_score,
  CASE WHEN r = 2 THEN NULL ELSE quality END AS phq8_binary, toxic AS gender, ['train', 'dev', 'test'][1 + r] AS split,
  {B.sql_band('CASE WHEN session_id % 5 = 0 THEN NULL ELSE session_id % 25 END', scores.BAND_NAMES)} AS severity FROM w JOIN labels ON session_id = doc_id""")
def scan_labels(spark, sf):
    """Three label files with shared ids, two score columns, blanks and text scores."""
    lab = B.read(spark, sf, "labels")
    files = []
    k = F.col("doc_id")
    for rank, split in enumerate(("train", "dev", "test")):
        path = scratch(spark, f"labels-{split}")
        score = F.when(k % 5 == 0, "n/a").otherwise(F.concat((k % 25).cast("string"), F.lit(".0")))
        rows = lab.filter((F.lit(rank) == 0) | (k % (rank + 1) == 0)).select(
            k.alias("Participant_ID"),
            F.when(F.lit(rank) == 2, "").otherwise(F.col("quality").cast("string")).alias("PHQ8_Binary"),
            score.alias("PHQ_Score" if rank == 2 else "PHQ8_Score"), F.col("toxic").alias("Gender"),
        )
        rows.write.options(**K.CSV).csv(path)
        files.append((path, split))
    return X.scan_labels(spark, files)


@query("scan_sessions_json", f"""WITH {B.TALK}, s AS (SELECT session_id * 1000 + turn_id AS session_id, string_split(raw, '. ') AS p FROM talk)
  SELECT session_id, CAST(unnest(range(0, len(p))) AS BIGINT) AS turn_id, CAST(session_id % 25 AS INTEGER) AS phq8_score, CASE WHEN generate_subscripts(p, 1) % 2 = 1 THEN 'Therapor' ELSE 'Patient' END AS role, unnest(p) AS text FROM s""")
def scan_sessions_json(spark, sf):
    """One session per given turn, its sentences as turns, in each of the known layouts."""
    path = scratch(spark, "sessions")
    turns = F.transform(
        F.split("raw", r"\. "),
        lambda x, i: F.struct(
            i.cast("long").alias("turn_id"), F.when(i % 2 == 0, "Therapor").otherwise("Patient").alias("role"), x.alias("text")
        ),
    )
    t, none = F.col("_t"), F.lit(None)
    rows = B.talk(spark, sf).withColumn("_t", turns).withColumn("_k", F.col("turn_id") % 4)
    rows.select(
        (F.col("session_id") * 1000 + F.col("turn_id")).alias("session_id"),
        ((F.col("session_id") * 1000 + F.col("turn_id")) % 25).alias("phq8_score"),
        F.when(F.col("_k") == 0, F.create_map(F.lit("standard_pune"), t)).alias("dialects"),
        F.when(F.col("_k") == 1, F.create_map(F.lit("other"), F.slice(t, 1, 1), F.lit("formal"), t)).alias("styles"),
        F.when(F.col("_k") == 2, t).alias("turns"), F.when(F.col("_k") == 3, t).alias("dialogue"),
    ).write.json(path)
    return D.scan_sessions(spark, path, multi_line=False).select("session_id", "turn_id", "phq8_score", "role", "text")


def _store(files, root):
    """Writes each row's content under its name."""

    def write(batches):
        system, folder = D.file_system(root)
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"]):
                with system.open_output_stream(f"{folder}/{name}") as f:
                    f.write(content)
            yield pdf[["name"]]

    system, folder = D.file_system(root)
    system.create_dir(folder)
    files.mapInPandas(write, "name string").write.format("noop").mode("overwrite").save()


@query("scan_zip_members", "SELECT doc_id, doc_id || '_TRANSCRIPT.csv' AS file_name, text AS content FROM documents")
def scan_zip_members(spark, sf):
    """Archives of many documents, each with a wanted and an unwanted member; the files are scanned."""
    root = scratch(spark, "archives")

    def pack(batches):
        for n, pdf in enumerate(b for b in batches if len(b)):
            body = io.BytesIO()
            with zipfile.ZipFile(body, "w") as z:
                for k, text in zip(pdf["doc_id"], pdf["text"]):
                    kind = zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED
                    z.writestr(f"{k}_P/{k}_TRANSCRIPT.csv", text, kind)
                    z.writestr(f"{k}_P/{k}_AUDIO.wav", "x")
            # One file per batch, named by its first document.
            yield pd.DataFrame({"name": [f"{pdf['doc_id'].iloc[0]}_{n}.zip"], "content": [body.getvalue()]})

    docs = B.read(spark, sf, "documents").select("doc_id", "text")
    _store(docs.mapInPandas(pack, "name string, content binary"), root)
    got = D.scan_zip_members(spark, root)
    return got.select(F.regexp_extract("file_name", r"^(\d+)", 1).cast("long").alias("doc_id"), "file_name", "content")


@query("scan_clip_metadata", "SELECT 'clip' || doc_id || '.wav' AS file_name, text AS transcript, lang AS language FROM documents")
def scan_clip_metadata(spark, sf):
    path = scratch(spark, "clips")
    B.read(spark, sf, "documents").select(
        F.concat(F.lit("clip"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("file_name"),
        F.col("text").alias("transcript"), F.concat(F.lit(" "), F.upper("lang")).alias("language"),
    ).write.options(**K.CSV).csv(path)
    return D.scan_clips(spark, path)


@query("scan_glossary", """SELECT 't' || item_id || '_' || k AS english, CASE k WHEN 'a' THEN text WHEN 'b' THEN 'f' || item_id WHEN 'c' THEN 'm' || item_id ELSE '' END AS marathi,
  CASE k WHEN 'b' THEN 'h' ELSE '' END AS hindi, 'clinical' AS category FROM benchmark, (VALUES ('a'), ('b'), ('c'), ('d')) v(k)""")
def scan_glossary(spark, sf):
    path = scratch(spark, "glossary")
    k = F.col("item_id").cast("string")

    def entry(tag, value):
        return F.concat(F.lit('"t'), k, F.lit(f'_{tag}": '), value)

    line = F.concat(
        F.lit("{"), entry("a", F.concat(F.lit('"'), F.replace("text", F.lit("\n"), F.lit("\\n")), F.lit('"'))), F.lit(", "),
        entry("b", F.concat(F.lit('{"formal": "f'), k, F.lit('", "marathi": "m", "hindi": "h"}'))), F.lit(", "),
        entry("c", F.concat(F.lit('{"marathi": "m'), k, F.lit('"}'))), F.lit(", "),
        entry("d", F.lit('{"note": "x"}')), F.lit("}"),
    )
    B.read(spark, sf, "benchmark").select(line.alias("value")).write.text(path)
    return D.scan_glossary(spark, path, whole_file=False)


@query("scan_reviews", """SELECT CAST(doc_id AS VARCHAR) AS session_id, CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE 'good' END AS overall_quality, quality = 0 AS needs_correction, CAST(toxic AS INTEGER) AS n_issues FROM labels""")
def scan_reviews(spark, sf):
    path = scratch(spark, "reviews")
    issue = F.struct(F.lit("plan").alias("section"), F.lit("style").alias("issue_type"))
    B.read(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("session_id"),
        F.when(F.col("doc_id") % 3 != 0, "good").alias("overall_quality"),
        F.when(F.col("quality") == 0, True).alias("needs_correction"),
        F.when(F.col("toxic") == 1, F.array(issue)).alias("issues"),
    ).write.json(path)
    return D.scan_reviews(spark, path, multi_line=False).select(
        "session_id", "overall_quality", "needs_correction", F.size("issues").alias("n_issues")
    )


@query("parse_review", """SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE 'good' END AS quality, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE quality = 0 END AS needs_correction FROM labels""")
def parse_review(spark, sf):
    k = F.col("doc_id") % 4
    body = F.to_json(F.struct(F.lit("good").alias("overall_quality"), (F.col("quality") == 0).alias("needs_correction")))
    reply = (
        F.when(k == 0, body).when(k == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nbye")))
        .when(k == 2, F.concat(F.lit("```\n"), body, F.lit("\n```"))).otherwise("{oops")
    )
    return B.read(spark, sf, "labels").select("doc_id", D.parse_review(reply).alias("r")).select(
        "doc_id", F.col("r.overall_quality").alias("quality"), F.col("r.needs_correction").alias("needs_correction")
    )


@query("scan_notes", f"""WITH {B.TALK}, s AS (SELECT *, turn_id % 4 AS k FROM talk WHERE turn_id % 4 <> 3)
  SELECT CASE WHEN k = 0 THEN 's' || session_id ELSE CAST(session_id AS VARCHAR) END AS session_id, 'soap_' || session_id || '_' || turn_id || '.json' AS file_name,
    CASE k WHEN 0 THEN raw WHEN 1 THEN '- ' || replace(raw, chr(10), ' ') ELSE en END AS subjective, CASE k WHEN 1 THEN '- two' ELSE '' END AS objective,
    CASE k WHEN 1 THEN '- three' ELSE '' END AS assessment, CASE k WHEN 1 THEN '- ' || replace(raw, chr(10), ' ') || '!' WHEN 2 THEN mr ELSE '' END AS plan FROM s""")
def scan_notes(spark, sf):
    """Nested, plain-text, top-level and broken note files."""
    k = F.col("turn_id") % 4
    said = F.replace("raw", F.lit("\n"), F.lit(" "))
    headed = F.concat(
        F.lit("**SUBJECTIVE:**\n"), said, F.lit("\n**OBJECTIVE:**\ntwo\n**ASSESSMENT:**\nthree\n**PLAN:**\n"), said, F.lit("!")
    )
    value = (
        F.when(k == 0, F.to_json(F.struct(
            F.concat(F.lit("s"), F.col("session_id").cast("string")).alias("session_id"),
            F.struct(F.col("raw").alias("subjective")).alias("soap_en"))))
        .when(k == 1, F.to_json(F.struct(headed.alias("soap_english"))))
        .when(k == 2, F.to_json(F.struct(F.col("en").alias("subjective"), F.col("mr").alias("plan"))))
        .otherwise(F.concat(F.lit("{broken "), "raw"))
    )
    name = F.concat(F.lit("soap_"), F.concat_ws("_", "session_id", "turn_id"), F.lit(".json"))
    root = scratch(spark, "notes")
    _store(B.talk(spark, sf).select(name.alias("name"), value.cast("binary").alias("content")), root)
    return D.scan_notes(spark, root).select("session_id", "file_name", "note.*")


def _sql_code_mix() -> str:
    return f"""ws AS (SELECT *, {B.sql_words('en')} AS w FROM talk),
  ks AS (SELECT *, list_filter(w, lambda x: list_contains({B.sql_list(rules.CODE_MIX_KEEP)}, lower(regexp_replace(x, '[^a-zA-Z]', '', 'g')))) AS k FROM ws)"""


MASTER = f"""{_sql_code_mix()}, {B.LABELS},
  st AS (SELECT *, 'formal_translated' AS style, mr AS text FROM ks
    UNION ALL SELECT *, 'colloquial', {sql_replace(sql_replace('mr', rules.SPOKEN_RULES), rules.SLANG_RULES)} FROM ks
    UNION ALL SELECT *, 'code_mixed', CASE WHEN len(k) = 0 THEN mr WHEN len(k) = len(w) THEN en WHEN len(k) <= 2 THEN mr || ' (' || array_to_string(k, ' ') || ')' ELSE mr END FROM ks),
  master AS (SELECT st.session_id, 'marathi' AS language, style, turn_id, turn_id * 1.0::DOUBLE AS start_time, turn_id + 0.5::DOUBLE AS stop_time, role,
    CASE WHEN role = 'Doctor' THEN 'डॉक्टर' ELSE 'रुग्ण' END AS role_label, en AS text_en, text, phq8_score, phq8_binary,
    {B.sql_band('phq8_score', scores.BAND_NAMES)} AS severity, gender, coalesce(split, 'unknown') AS split FROM st LEFT JOIN lab USING (session_id))"""
MASTER_TYPES = """session_id long, language string, style string, turn_id long, start_time double, stop_time double, role string,
  role_label string, text_en string, text string, phq8_score int, phq8_binary int, severity string, gender int, split string"""


def _read_csv(spark, path, schema, sep=","):
    return spark.read.schema(schema).options(
        header=True, multiLine=True, escape='"', sep=sep, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


@query("sink_turn_files", f"WITH {B.TALK}, {MASTER} SELECT session_id, language, style, turn_id, start_time, stop_time, role AS speaker, role_label, text_en, text FROM master")
def sink_turn_files(spark, sf):
    path = scratch(spark, "turn-files")
    K.write_turn_files(B.master(spark, sf), path)
    return K.read_turn_files(spark, path)


@query("sink_turn_manifest", f"WITH {B.TALK}, {MASTER} SELECT session_id, language, style, count(*) AS rows, min(turn_id) AS first_turn, max(turn_id) AS last_turn FROM master GROUP BY ALL")
def sink_turn_manifest(spark, sf):
    """What the manifest of the transcript files says of each variant."""
    path = scratch(spark, "turn-files")
    K.write_turn_files(B.master(spark, sf), path)
    held = spark.read.parquet(f"{path}/manifest")
    return held.groupBy("session_id", "language", "style").agg(
        F.sum("rows").alias("rows"), F.min("first_turn").alias("first_turn"), F.max("last_turn").alias("last_turn")
    )


@query("sink_metadata", f"WITH {B.TALK}, {MASTER} SELECT session_id, language, style, any_value(phq8_score) AS phq8_score, any_value(phq8_binary) AS phq8_binary, any_value(severity) AS severity, any_value(gender) AS gender, any_value(split) AS split, count(*) AS n_turns FROM master GROUP BY ALL")
def sink_metadata(spark, sf):
    path = scratch(spark, "metadata")
    K.write_metadata(B.master(spark, sf), path)
    return spark.read.schema(
        "session_id long, language string, style string, phq8_score int, phq8_binary int, severity string, gender int, split string, n_turns long"
    ).json(path)


@query("sink_master_csv", f"WITH {B.TALK}, {MASTER} SELECT * FROM master")
def sink_master_csv(spark, sf):
    path = scratch(spark, "master")
    K.write_master_csv(B.master(spark, sf), path)
    return _read_csv(spark, path, MASTER_TYPES)


@query("sink_master_grouped", f"""WITH {B.TALK}, {MASTER} SELECT session_id || '_' || language || '_' || style AS key, CAST(turn_id // 3 AS BIGINT) AS page, CAST(count(*) AS INTEGER) AS n_rows,
  string_agg(turn_id || ':' || role, ',' ORDER BY turn_id) AS outline, string_agg(text, chr(10) ORDER BY turn_id) AS texts FROM master GROUP BY ALL""")
def sink_master_grouped(spark, sf):
    path = scratch(spark, "grouped")
    pages = T.master_pages(B.master(spark, sf), page_rows=3)
    K.write_master_pages(pages, path)
    got = spark.read.schema(pages.schema).json(path)
    return got.select(
        "key", "page", F.size("rows").alias("n_rows"),
        F.array_join(F.transform("rows", lambda r: F.concat(r["turn_id"].cast("string"), F.lit(":"), r["role"])), ",").alias("outline"),
        F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("texts"),
    )


INDEX = f"""ix AS (SELECT session_id, count(*) AS n_turns, count(*) FILTER (WHERE role = 'Patient') AS n_patient_turns, arg_max(stop_time, turn_id) AS session_duration_sec FROM timed GROUP BY session_id)
  SELECT session_id, phq8_score, phq8_binary, {B.sql_band('phq8_score', scores.BAND_NAMES)} AS severity, gender, coalesce(split, 'unknown') AS split, n_turns, n_patient_turns, session_duration_sec FROM ix LEFT JOIN lab USING (session_id)"""


@query("sessions_index", f"WITH {B.TALK}, {B.TIMED}, {B.LABELS}, {INDEX}")
def sessions_index(spark, sf):
    return T.session_index(B.timed(spark, sf), B.labels(spark, sf))


@query("sink_sessions_index", f"WITH {B.TALK}, {B.TIMED}, {B.LABELS}, {INDEX}")
def sink_sessions_index(spark, sf):
    path = scratch(spark, "index")
    index = sessions_index(spark, sf)
    K.write_index(index, path)
    return _read_csv(spark, path, index.schema)


@query("sink_training_jsonl", f"""WITH {B.TALK}, {EXAMPLES}, r AS (SELECT *, row_number() OVER (ORDER BY {sql_hash("(session_id || '_' || turn_id)", '42')}, session_id || '_' || turn_id) - 1 AS rk, count(*) OVER () AS n FROM ex)
  SELECT CASE WHEN rk < floor(n * 0.8) THEN 'train' ELSE 'val' END AS split, prompt, response FROM r""")
def sink_training_jsonl(spark, sf):
    path = scratch(spark, "training")
    ex = _examples(spark, sf).withColumn("id", F.concat_ws("_", "session_id", "turn_id"))
    K.write_training_lines(P.split_two_way(ex, "id"), path)
    return spark.read.schema("prompt string, response string, split string").json(path)


@query("training_metadata", f"""WITH {B.TALK} SELECT count(*) AS total_rows, CAST(floor(count(*) * 0.8) AS BIGINT) AS train_examples, CAST(count(*) - floor(count(*) * 0.8) AS BIGINT) AS val_examples FROM talk""")
def training_metadata(spark, sf):
    ids = B.talk(spark, sf).select(F.concat_ws("_", "session_id", "turn_id").alias("id"))
    return K.training_metadata(P.split_two_way(ids, "id"))


@query("corrected_metadata", f"""WITH {B.TALK}, x AS (SELECT turn_id % 3 = 0 AS corrected, CASE WHEN turn_id % 3 = 0 THEN length(raw) % 7 ELSE 0 END AS fixed, speaker AS quality FROM talk),
  q AS (SELECT string_agg(quality || ':' || n, ',' ORDER BY quality) AS d FROM (SELECT quality, count(*) AS n FROM x GROUP BY quality))
  SELECT count(*) AS total_rows, CAST(floor(count(*) * 0.8) AS BIGINT) AS train_examples, CAST(count(*) - floor(count(*) * 0.8) AS BIGINT) AS val_examples,
    count(*) FILTER (WHERE corrected) AS corrected, count(*) FILTER (WHERE NOT corrected) AS validated, CAST(sum(fixed) AS BIGINT) AS total_issues_fixed, (SELECT d FROM q) AS quality_distribution FROM x""")
def corrected_metadata(spark, sf):
    """Issues and quality that follow from each turn."""
    fixed = F.when(F.col("turn_id") % 3 == 0, F.length("raw") % 7).otherwise(0)
    ex = B.talk(spark, sf).select(
        F.concat_ws("_", "session_id", "turn_id").alias("id"), (F.col("turn_id") % 3 == 0).alias("corrected"),
        fixed.alias("num_issues_fixed"), F.col("speaker").alias("quality"),
    )
    entry = lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))
    return K.corrected_metadata(P.split_two_way(ex, "id")).withColumn(
        "quality_distribution", F.array_join(F.transform(F.map_entries("quality_distribution"), entry), ",")
    )
