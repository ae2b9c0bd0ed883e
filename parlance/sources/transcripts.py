"""Transcript files: one interview per file, tab or comma separated."""

from __future__ import annotations

import csv
import io
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions import scores
from parlance.functions.text import strip
from parlance.operators.turns import with_metrics, with_roles

# Transcript columns and how many characters decide the separator.
COLUMNS = ["start_time", "stop_time", "speaker", "value"]
PROBE_CHARS = 512
# Bytes of a file that are looked at for its header, and how many files at a time.
HEAD_BYTES = 1 << 16
HEAD_READERS = 32
GLOB_MARKS = str.maketrans({c: "\\" + c for c in "\\*?[]{}"})


def _head(spark: SparkSession, path: str, size: int) -> str:
    """The first bytes of a file of any file system Spark can open."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)).decode("utf-8", "ignore")
    finally:
        stream.close()


def _layout(head: str, sep: str | None) -> tuple[tuple[str, ...], str] | None:
    """Column names and separator of a file that starts like this; None if it is empty."""
    if sep is None:
        sep = "\t" if "\t" in head[:PROBE_CHARS] else ","
    names = next(csv.reader(io.StringIO(head, newline=""), delimiter=sep), None)
    return None if names is None else (tuple(names), sep)


def _scan(spark: SparkSession, paths: list[str], names: tuple[str, ...], sep: str, suffix: str) -> DataFrame:
    """Rows of files of one layout, the wanted columns by name; of equal names the last counts."""
    at = {name: i for i, name in enumerate(names)}
    rows = (
        spark.read.schema(", ".join(f"c{i} string" for i in range(max(len(names), 1))))
        .options(sep=sep, quote='"', escape='"', header=True, multiLine=True, encoding="UTF-8",
                 ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
                 recursiveFileLookup=True, pathGlobFilter=suffix)
        .csv(paths)
    )
    none = F.lit(None).cast("string")
    return rows.select(
        F.col("_metadata.file_path").alias("_file"),
        F.monotonically_increasing_id().alias("_row"),
        *[(F.col(f"c{at[c]}") if c in at else none).alias(c) for c in COLUMNS],
    )


def scan_transcripts(
    spark: SparkSession, path: str, sep: str | None = None,
    clinicians: list[str] = scores.CLINICIANS, session_id: Column | None = None,
    suffix: str = "*",
) -> DataFrame:
    """Turns of all transcripts under ``path`` with roles, word counts and durations.

    The first 512 characters of a file pick its separator, unless ``sep`` names it; columns
    are found by their names in the header, whatever their order and number and quoted or
    not. The heads of the files, ``HEAD_BYTES`` each, are read before the scan is planned;
    files of one header and separator are one CSV scan with its own columns. A quote inside
    an unquoted field is part of it, a quoted field may hold separators and line ends. After
    the scan the rows of a file meet once, to be numbered. Files whose name carries no
    session number and empty files are skipped.
    """
    sid = session_id if session_id is not None else scores.session_id_from_path(F.col("_file"))
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", suffix).load(path)
        .select(F.col("path").alias("_file"), F.least("length", F.lit(HEAD_BYTES)).cast("int").alias("size"))
    )
    files = listed.filter(sid.isNotNull()).filter("size > 0").collect()
    with ThreadPoolExecutor(HEAD_READERS) as pool:
        heads = list(pool.map(lambda f: _head(spark, f["_file"], f["size"]), files))
    layouts: dict[tuple, list[str]] = {}
    for file, head in zip(files, heads):
        layouts.setdefault(_layout(head, sep), []).append(file["_file"])
    layouts.pop(None, None)
    scans = [
        _scan(spark, [path] if len(layouts) == 1 else [f.translate(GLOB_MARKS) for f in own], *layout, suffix)
        for layout, own in layouts.items()
    ]
    if not scans:
        kinds = ["_file string", "_row long", *[f"{c} string" for c in COLUMNS]]
        scans = [spark.createDataFrame([], ", ".join(kinds))]
    rows = scans[0]
    for other in scans[1:]:
        rows = rows.unionByName(other)
    number = F.row_number().over(Window.partitionBy("session_id", "_file").orderBy("_row")) - 1
    turns = rows.withColumn("session_id", sid).filter("session_id IS NOT NULL").select(
        "session_id", number.cast("long").alias("turn_id"), "start_time", "stop_time",
        strip(F.coalesce("speaker", F.lit(""))).alias("speaker"),
        strip(F.coalesce("value", F.lit(""))).alias("text_en"),
    )
    return with_metrics(with_roles(turns, clinicians))


def scan_labels(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    """Label rows of (path, split) CSV files; per id the last row of the last file wins."""
    union = None
    for rank, (path, split) in enumerate(files):
        raw = spark.read.option("header", True).csv(path)
        for name in ("Participant_ID", "PHQ8_Score", "PHQ_Score", "PHQ8_Binary", "Gender"):
            if name not in raw.columns:
                raw = raw.withColumn(name, F.lit(None).cast("string"))
        part = raw.select(
            F.btrim("Participant_ID").try_cast("long").alias("session_id"),
            scores.score_of(F.col("PHQ8_Score"), F.col("PHQ_Score")).alias("phq8_score"),
            scores.int_of(F.col("PHQ8_Binary")).alias("phq8_binary"),
            scores.int_of(F.col("Gender")).alias("gender"),
            F.lit(split).alias("split"),
            F.struct(F.lit(rank).alias("f"), F.monotonically_increasing_id().alias("r")).alias("_at"),
        )
        union = part if union is None else union.unionByName(part)
    return latest_labels(union.filter("session_id IS NOT NULL"), F.col("_at"))


def latest_labels(labels: DataFrame, at: Column) -> DataFrame:
    """One row per session: the one with the greatest ``at``."""
    fields = ["phq8_score", "phq8_binary", "gender", "split"]
    return (
        labels.groupBy("session_id").agg(F.max_by(F.struct(*fields), at).alias("_l"))
        .select("session_id", "_l.*")
        .withColumn("severity", scores.band(F.col("phq8_score")))
    )
