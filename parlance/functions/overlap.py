"""Token overlap and edit distances between two texts of one row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions.text import let


def numbered(items: Column) -> Column:
    """Tag equal strings 1, 2, 3, … so that a set operation acts on the multiset."""

    def tag(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(
            F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )

        def expand(st: Column) -> Column:
            runs = F.transform(
                st,
                lambda a, k: F.struct(
                    F.get(s, a).alias("item"), (F.coalesce(F.get(st, k + 1), n) - a).alias("count")
                ),
            )
            return F.flatten(
                F.transform(
                    runs,
                    lambda r: F.transform(
                        F.sequence(F.lit(1), r["count"]),
                        lambda k: F.concat(r["item"], F.lit("\x01"), k.cast("string")),
                    ),
                )
            )

        return let(starts, expand)

    return let(F.array_sort(items), tag)


def multiset_overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(numbered(a), numbered(b)))


def ngrams(items: Column, n: int) -> Column:
    if n == 1:
        return items

    def build(t: Column) -> Column:
        count = F.size(t) - (n - 1)
        at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(at, lambda i: F.concat_ws(" ", *[F.get(t, i + k) for k in range(n)]))

    return let(items, build)


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator != 0, numerator / denominator).otherwise(F.lit(0.0))


def prf(overlap: Column, n_pred: Column, n_ref: Column) -> Column:
    """struct<precision, recall, f1> from an overlap count and two sizes."""
    return let(
        F.struct(ratio(overlap, n_pred).alias("p"), ratio(overlap, n_ref).alias("r")),
        lambda x: F.struct(
            x["p"].alias("precision"),
            x["r"].alias("recall"),
            ratio(2 * x["p"] * x["r"], x["p"] + x["r"]).alias("f1"),
        ),
    )


def token_prf(pred: Column, ref: Column) -> Column:
    return prf(multiset_overlap(pred, ref), F.size(pred), F.size(ref))


def rouge_n(pred: Column, ref: Column, n: int) -> Column:
    return let(
        F.struct(ngrams(pred, n).alias("p"), ngrams(ref, n).alias("r")),
        lambda g: token_prf(g["p"], g["r"])["f1"],
    )


def _codes(a: list, b: list) -> tuple[np.ndarray, np.ndarray]:
    ids: dict = {}
    return tuple(
        np.fromiter((ids.setdefault(t, len(ids)) for t in side), dtype=np.int64, count=len(side))
        for side in (a, b)
    )


@F.pandas_udf(T.LongType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence, with one big integer per row of the table."""

    def one(x, y) -> int:
        where: dict = {}
        for i, t in enumerate(x):
            where[t] = where.get(t, 0) | (1 << i)
        full = (1 << len(x)) - 1
        state = full
        for t in y:
            hits = state & where.get(t, 0)
            state = ((state + hits) | (state - hits)) & full
        return len(x) - state.bit_count()

    return pd.Series([one(x, y) for x, y in zip(a, b)])


@F.pandas_udf(T.LongType())
def word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Word edit distance; each table row is one vector operation."""

    def one(x, y) -> int:
        cx, cy = _codes(x, y)
        if len(cx) > len(cy):
            cx, cy = cy, cx
        col = np.arange(len(cy) + 1)
        row = col.copy()
        for i, t in enumerate(cx, 1):
            best = np.minimum(row[1:] + 1, row[:-1] + (cy != t))
            row = np.concatenate(([i], best)) - col
            row = np.minimum.accumulate(row) + col
        return int(row[-1])

    return pd.Series([one(x, y) for x, y in zip(a, b)])


def rouge_l(pred: Column, ref: Column) -> Column:
    return prf(lcs_length(pred, ref), F.size(pred), F.size(ref))["f1"]


def exact_match(pred_norm: Column, ref_norm: Column) -> Column:
    return ((pred_norm == ref_norm) & (ref_norm != "")).cast("double")


def presence_match(pred_norm: Column, ref_norm: Column) -> Column:
    return ((pred_norm != "") == (ref_norm != "")).cast("double")
