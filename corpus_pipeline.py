"""A training corpus out of raw documents: five operators in a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import (
    common, decontamination, exact_dedup, jaccard_join, labelled, packing, queries, toxicity,
)
from parlance.session import scratch

TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the threshold.

    The model learns from labelled rows outside the held-out fold. A null or empty text gets
    the score of an empty one, a long text that of its worst window; rows with equal texts
    stay or go together. Null ids are scored like others. All columns come back as given,
    also one named like the score. An empty table stays empty; without labels of both kinds
    all texts get one score, far below the threshold.
    """
    labels = queries.table(spark, sf_dir, "labels", "doc_id", "toxic")
    keep = ~labelled.in_fold("doc_id", 4, 2)
    net = toxicity.train(labelled.labelled_sample(docs, labels, "toxic", keep))
    score = common.free_name("score", docs.columns)
    scored = toxicity.score_toxicity(docs, net, keep_text=True, score=score)
    return scored.filter(F.col(score) < TOXIC).select(*docs.columns)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, A-Z lower-cased, the one with the largest id.

    Null counts as empty, whole texts are compared, of rows with the same text and id one
    stays, a null id loses to others. All columns come back as given; an empty table stays
    empty.
    """
    return exact_dedup.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents, the one with the smallest id.

    Documents without words are like nothing and all stay; of rows with the same id the
    first one read stays, a null id loses to others. Whole texts are compared. All columns
    come back as given; an empty table stays empty.
    """
    return jaccard_join.keep_one(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none, whole texts are read, repeated rows stay or go together.
    All columns come back as given; an empty table, or an empty benchmark, changes nothing.
    """
    return decontamination.drop_leaks(
        docs, queries.table(spark, sf_dir, "benchmark", "item_id", "text")
    )


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their place in a sequence.

    Null counts as empty, and every row, also one that repeats, has at least its end id; a
    long text is cut into as many pieces as it fills. Other columns than the id are left
    behind; an empty table has no pieces.
    """
    return packing.pack(docs, queries.vocabulary(), with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact),
    ("near dedup", drop_near),
    ("decontamination", drop_leaked),
    ("packing", pack),
]
# A network, a similarity join and a tokenizer: SQL expresses none of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
