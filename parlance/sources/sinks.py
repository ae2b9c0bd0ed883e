"""Outputs: transcript files, metadata, master tables, session index, training lines.

Transcripts lie in a fixed number of folders by a hash of the session, with a manifest that
says where a session's variants are. Large sessions are spread over several: rows are hashed
on (session, bucket of turns) and each file holds a bounded number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.turns import (
    INDEX_COLUMNS, MASTER_COLUMNS, turn_bucket, variant_metadata,
)

TURN_FILE_COLUMNS = ["start_time", "stop_time", "speaker", "role_label", "text_en", "text"]
TURN_FILE_SCHEMA = (
    "session_id long, language string, style string, turn_id long, start_time double, "
    "stop_time double, speaker string, role_label string, text_en string, text string"
)
FILE_ROWS = 1_000_000
TURN_FOLDERS = 64
CSV = {
    "header": True, "escape": '"', "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False, "emptyValue": "",
}


def _turn_rows(master: DataFrame, *extra: Column) -> DataFrame:
    return master.withColumn("speaker", F.col("role")).select(
        "session_id", "language", "style", "turn_id", *TURN_FILE_COLUMNS, *extra
    )


def write_turn_files(master: DataFrame, path: str, folders: int = TURN_FOLDERS) -> None:
    """Tab-separated transcripts under ``path``/turns and where they lie under ``path``/manifest.

    A row's folder follows from its session and bucket of turns, so the number of folders does
    not grow with the sessions, and one session is one file unless it has very many turns.
    Inside a file the rows go by session, language, style and turn. The manifest has
    session_id, language, style, folder, rows, first_turn and last_turn; it comes from the
    rows themselves and is written last.
    """
    folder = F.pmod(F.xxhash64("session_id", turn_bucket()), F.lit(folders)).cast("int")
    rows = _turn_rows(master, folder.alias("folder"))
    (
        rows.repartition("folder")
        .sortWithinPartitions("folder", "session_id", "language", "style", "turn_id")
        .write.mode("overwrite").partitionBy("folder")
        .option("maxRecordsPerFile", FILE_ROWS).options(sep="\t", **CSV).csv(f"{path}/turns")
    )
    variant = ["session_id", "language", "style", "folder"]
    rows.groupBy(*variant).agg(
        F.count("*").alias("rows"), F.min("turn_id").alias("first_turn"), F.max("turn_id").alias("last_turn"),
    ).write.mode("overwrite").parquet(f"{path}/manifest")


def read_turn_files(
    spark: SparkSession, path: str, sessions: list[int] | None = None
) -> DataFrame:
    """Transcript rows; of the given sessions only, which opens the folders the manifest names."""
    found = spark.read.schema(TURN_FILE_SCHEMA + ", folder int").options(
        header=True, multiLine=True, escape='"', sep="\t", ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(f"{path}/turns")
    if sessions is not None:
        wanted = F.col("session_id").isin(sessions)
        held = spark.read.parquet(f"{path}/manifest").filter(wanted).select("folder").distinct()
        # As many folders as were asked for at most, whatever the number of sessions.
        found = found.filter(F.col("folder").isin([r.folder for r in held.collect()]) & wanted)
    return found.drop("folder")


def export_turn_folders(master: DataFrame, path: str, sessions: list[int]) -> None:
    """Transcripts of some sessions as a tree of session / language / style folders."""
    (
        _turn_rows(master.filter(F.col("session_id").isin(sessions)))
        .repartition("session_id", "language", "style")
        .sortWithinPartitions("session_id", "language", "style", "turn_id")
        .write.mode("overwrite").partitionBy("session_id", "language", "style")
        .options(sep="\t", **CSV).csv(path)
    )


def write_metadata(master: DataFrame, path: str) -> None:
    variant_metadata(master).write.mode("overwrite").json(path)


def write_master_csv(master: DataFrame, path: str) -> None:
    master.select(*MASTER_COLUMNS).write.mode("overwrite").options(**CSV).csv(path)


def write_master_pages(pages: DataFrame, path: str) -> None:
    pages.write.mode("overwrite").json(path)


def write_index(index: DataFrame, path: str) -> None:
    index.select(*INDEX_COLUMNS).write.mode("overwrite").options(**CSV).csv(path)


def write_training_lines(examples: DataFrame, path: str) -> None:
    """prompt / response lines in one folder per split."""
    examples.select("split", "prompt", "response").write.mode("overwrite").partitionBy("split").json(path)


def corrected_metadata(examples: DataFrame) -> DataFrame:
    """What a corrected training set holds: sizes, corrections, and examples per quality.

    ``examples``: split, corrected, num_issues_fixed, quality.
    """
    per_quality = examples.groupBy("quality").agg(F.count("*").alias("n")).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce("quality", F.lit("unknown")), "n")))).alias("q")
    )
    return examples.agg(
        *_sizes(),
        F.count_if("corrected").alias("corrected"),
        F.count_if(~F.col("corrected")).alias("validated"),
        F.coalesce(F.sum("num_issues_fixed"), F.lit(0)).cast("long").alias("total_issues_fixed"),
    ).withColumn("quality_distribution", per_quality.scalar())


def _sizes() -> list[Column]:
    return [
        F.count("*").alias("total_rows"),
        F.count_if(F.col("split") == "train").alias("train_examples"),
        F.count_if(F.col("split") == "val").alias("val_examples"),
    ]


def training_metadata(examples: DataFrame) -> DataFrame:
    return examples.agg(*_sizes())
