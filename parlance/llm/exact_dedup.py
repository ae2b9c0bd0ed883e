"""Exact duplicates by skew-safe combining, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import ROW, ascii_lower, keeps_columns, numbered

# Sub-groups a group of copies is spread over before its winners meet.
SALTS = 32
# What names a text once full contents have been compared.
NAME = ["digest", "chars", "check"]


def normal_text(text: str | Column) -> Column:
    """The text two copies have in common: null counts as empty, A-Z are lower-cased."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Copies have the same normalised text; the one with the largest id stays. The first
    combining runs inside each task, the second per (digest, salt), the third over the
    winners of all salts of a digest. Each groups by the whole text next to its digest.
    What returns to the rows is one winner per text, looked up by its sha256, length and
    a second hash, so the text is not moved a third time.

    Nulls and empty texts form one group. Rows that repeat an id count one by one: of
    rows with the largest id all are marked ``kept``, since nothing tells them apart;
    ``drop_copies`` keeps one. A null id loses to any other; a group of null ids only has
    a null ``keep_id`` and keeps its rows. Extra columns are ignored. An empty table
    gives an empty table.
    """
    rows = docs.select(F.col(id_col).alias("id"), normal_text(text).alias("body"))
    return _judged(rows).select(
        "id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


@keeps_columns
def drop_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, columns as given: of each text the row with the largest id.

    Of rows that share text and id, whole repeats included, one stays. Other cases are as
    in ``exact_groups``.
    """
    given = numbered(docs)
    rows = given.select(ROW, F.col(id_col).alias("id"), normal_text(text).alias("body"))
    stay = _judged(rows).filter("kept").groupBy(*NAME).agg(F.max(ROW).alias(ROW))
    return given.join(stay.select(ROW), ROW, "left_semi").select(*docs.columns)


def _judged(rows: DataFrame) -> DataFrame:
    """Rows without their body, with their text's name and winner."""
    rows = rows.withColumn("digest", F.unhex(F.sha2("body", 256)))
    name = ["digest", F.length("body").alias("chars"), F.xxhash64("body").alias("check")]
    per_salt = (
        rows.withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS)))
        .groupBy("digest", "body", "salt")
        .agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))
    )
    winners = (
        per_salt.groupBy("digest", "body")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
        .select(*name, "keep_id", "group_size")
    )
    named = rows.select(*[c for c in rows.columns if c not in ("body", "digest")], *name)
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    return named.join(winners, NAME).withColumn("kept", kept)
