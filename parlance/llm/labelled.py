"""Bounded samples of labelled documents, and scores made from a model's outputs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.words import text_slices


def in_fold(key: str | Column, folds: int, fold: int) -> Column:
    """Whether the crc32 of a key's text falls into a fold; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds == fold


@dataclass
class Sample:
    """Texts, 0/1 labels, and weights that give the classes their share among all rows."""

    texts: list[str]
    labels: np.ndarray
    weights: np.ndarray


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    keep: Column,
    id_col: str = "doc_id",
    per_class: tuple[int, int] = (3000, 1500),
    max_chars: int = 40_000,
) -> Sample:
    """At most ``per_class`` documents of labels 0 and 1 among the rows for which ``keep`` holds.

    The documents are those with the smallest hash of their id, so the choice is the same
    on every run. Longer ones than ``max_chars`` are left out of the sample. Labels
    other than 0 and 1, null ids and unknown documents are ignored. This is the only place
    where the driver sees texts; both bounds are parameters.
    """
    known = labels.filter(keep & F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(id_col).agg(F.max(label).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picks = None
    for value in (0, 1):
        rank = F.pmod(F.xxhash64(id_col), F.lit(1 << 31))
        # Twice what is wanted goes on, so no task has to send its own best many.
        share = min(1.0, 2 * per_class[value] / max(1, counts.get(value, 0)))
        part = known.filter((F.col("label") == value) & (rank < int(share * (1 << 31))))
        part = part.orderBy(rank, id_col).limit(per_class[value])
        picks = part if picks is None else picks.unionByName(part)
    # At most sum(per_class) rows.
    rows = (
        docs.select(id_col, F.coalesce("text", F.lit("")).alias("text"))
        .filter(F.length("text") <= max_chars)
        .join(F.broadcast(picks), id_col)
        .select("label", "text", F.xxhash64(id_col).alias("at"))
        .toPandas()
        .sort_values(["at", "text"], kind="stable")
    )
    y = rows["label"].to_numpy(np.int64)
    weights = np.ones(len(y))
    for value in (0, 1):
        own = y == value
        if own.any():
            weights[own] = counts.get(value, 0) / own.sum()
    return Sample(rows["text"].tolist(), y, weights / max(weights.mean(), 1e-9))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


# Rows of the base rate that a fit starts from; they count where there are few others.
PRIOR_ROWS = 10


def calibrate(
    raw: np.ndarray, y: np.ndarray, weights: np.ndarray, base: float
) -> tuple[float, float]:
    """Slope and offset of a logistic fit of labels on raw scores; the slope stays positive.

    ``base`` is the share of label 1 among all rows, which a few rows cannot tell.
    """
    if len(y) == 0:
        return 1.0, 0.0
    mean, scale = raw.mean(), raw.std() + 1e-6
    x = np.append((raw - mean) / scale, 0.0)
    a, b = 1.0, float(np.log(base + 1e-3) - np.log(1 - base + 1e-3))
    # Targets short of 0 and 1 keep the fit finite where classes are apart.
    n1, n0 = (weights * y).sum(), (weights * (1 - y)).sum()
    target = np.append(np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2)), base)
    weights = np.append(weights, PRIOR_ROWS * weights.mean())
    for _ in range(50):
        p = sigmoid(a * x + b)
        g = weights * (p - target)
        h = weights * p * (1 - p) + 1e-9
        ga, gb = (g * x).sum() + 1e-3 * a, g.sum()
        haa, hab, hbb = (h * x * x).sum() + 1e-3, (h * x).sum(), h.sum()
        det = haa * hbb - hab * hab + 1e-12
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
        if abs(da) + abs(db) < 1e-8:
            break
    a = max(a, 0.05)
    return float(a / scale), float(b - a * mean / scale)


def score_texts(
    docs: DataFrame,
    prepare: Callable[[], Callable[[list[str]], np.ndarray]],
    text: str = "text",
    score: str = "score",
    keep_text: bool = False,
) -> DataFrame:
    """The rows with a score in place of their text, or next to it.

    ``prepare`` runs once per task and gives a function from texts to scores. Null counts
    as empty text; other columns pass through.
    """
    given = [c for c in docs.columns if c not in (text, score) or keep_text and c == text]
    read = docs.select(*given, F.coalesce(text, F.lit("")).alias(score))
    schema = T.StructType([*read.schema.fields[:-1], T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = prepare()
        for batch in batches:
            texts = batch[score].tolist()
            out = np.zeros(len(texts))
            for a, b in text_slices(texts):
                out[a:b] = scorer(texts[a:b])
            yield batch.assign(**{score: out})

    return read.mapInPandas(run, schema)
