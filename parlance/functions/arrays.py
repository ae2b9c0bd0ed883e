"""Helpers for arrays inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once per row and use it many times in ``body``.

    A plain column captured by a lambda is evaluated again for every element;
    a lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


# Elements that are summed together on the way to running sums.
BLOCK = 256


def running(items: Column, join: Callable[[Column, Column], Column]) -> Column:
    """``join`` of all elements up to each one, for arrays of ints of at least 0.

    Totals of blocks are run through first, then each element goes through its own block:
    work grows with the elements times the block, not with their square.
    """
    def upto(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), join)

    def blocks(n: Column) -> Column:
        return F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))

    def fill(b: Column) -> Column:
        own, heads = b["own"], b["heads"]
        return F.transform(
            own,
            lambda _, i: join(
                F.get(heads, F.floor(i / BLOCK).cast("int")),
                upto(F.slice(own, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1)),
            ),
        )

    def run(own: Column) -> Column:
        totals = F.transform(blocks(F.size(own)), lambda k: upto(F.slice(own, k * BLOCK + 1, F.lit(BLOCK))))
        heads = let(
            totals,
            lambda t: F.transform(t, lambda _, k: upto(F.slice(t, F.lit(1), k))),
        )
        return let(F.struct(own.alias("own"), heads.alias("heads")), fill)

    return let(items, lambda own: F.when(F.size(own) > 0, run(own)).otherwise(own))
