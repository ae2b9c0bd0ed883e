"""Rows out of arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(
    df: DataFrame, keep: list[str | Column], array: Column, name: str, pos: str | None = None
) -> DataFrame:
    """One row per array element, with its position if ``pos`` is given.

    For an inner generator Spark adds a filter on the array's size below it and so
    computes the array twice. The outer form, with empty arrays dropped afterwards,
    computes it once.
    """
    at = pos or "_pos"
    out = df.select(*keep, F.posexplode_outer(array).alias(at, name))
    out = out.filter(F.col(at).isNotNull())
    return out if pos else out.drop(at)


def inline_rows(df: DataFrame, keep: list[str | Column], array: Column) -> DataFrame:
    """One row per struct of an array, its fields as columns."""
    out = explode_rows(df, [*keep], array, "_item")
    return out.select(*[c for c in out.columns if c != "_item"], "_item.*")
