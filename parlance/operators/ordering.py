"""Ordered computations over groups of any size.

A window partitioned by a session puts the whole session into one task. Here each
session is cut into bounded, order-preserving buckets: windows run per (session,
bucket), one summary row per bucket carries the state across bucket borders, and the
summaries are joined back on (session, bucket).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Test of (this row, previous row).
Step = Callable[[Column, Column], Column]

# Hex digits of a hash that are counted together: 4096 values.
HASH_DIGITS = 3

# Rows per bucket when the order column is a dense counter.
BUCKET_ROWS = 65536


def prefix(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    lag: Mapping[str, Column] | None = None,
    running_sum: Mapping[str, Column] | None = None,
    last_value: Mapping[str, Column] | None = None,
    next_value: Mapping[str, Column] | None = None,
    step_sum: Mapping[str, tuple[Column, Step]] | None = None,
    position: str | None = None,
) -> DataFrame:
    """Add columns computed along ``order`` inside each group of ``keys``.

    ``bucket`` must not decrease along ``order``, and (keys, order) must be unique.
    ``lag`` gives the value on the previous row, ``running_sum`` includes the current
    row, ``last_value`` and ``next_value`` are the nearest non-NULL values up to and from
    the current row, and ``position`` counts from 0. ``step_sum`` counts, up to the
    current row, the rows for which a test of (this row's struct, the previous row's
    struct) holds.
    """
    lag, last_value, next_value = lag or {}, last_value or {}, next_value or {}
    running_sum, step_sum = dict(running_sum or {}), step_sum or {}
    if position:
        running_sum[position] = F.lit(1).cast("long")
    keys, order = list(keys), list(order)
    part = [*keys, "_bucket"]
    values = {**lag, **running_sum, **last_value, **next_value,
              **{n: inputs for n, (inputs, _) in step_sum.items()}}

    def holds(name: str, this: Column, before: Column) -> Column:
        test = step_sum[name][1](this, before)
        return F.when(before.isNotNull() & test, 1).otherwise(0).cast("long")

    work = df.withColumn("_bucket", bucket)
    for name, value in values.items():
        work = work.withColumn(f"_v_{name}", value)

    inside = Window.partitionBy(*part).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    onward = inside.rowsBetween(0, Window.unboundedFollowing)
    if step_sum:
        # Tests inside a bucket; the first row of a bucket is tested between buckets.
        for n in step_sum:
            work = work.withColumn(
                f"_h_{n}", holds(n, F.col(f"_v_{n}"), F.lag(f"_v_{n}").over(inside))
            )

    at = F.struct(*order)

    def some(name: str) -> Column:
        return F.when(F.col(f"_v_{name}").isNotNull(), at)

    totals = [F.lit(True).alias("_any")]
    totals += [F.max_by(f"_v_{n}", at).alias(f"_t_{n}") for n in lag]
    totals += [F.sum(f"_v_{n}").alias(f"_t_{n}") for n in running_sum]
    totals += [F.max_by(f"_v_{n}", some(n)).alias(f"_t_{n}") for n in last_value]
    totals += [F.min_by(f"_v_{n}", some(n)).alias(f"_t_{n}") for n in next_value]
    for n in step_sum:
        totals += [F.sum(f"_h_{n}").alias(f"_t_{n}"), F.min_by(f"_v_{n}", at).alias(f"_a_{n}"),
                   F.max_by(f"_v_{n}", at).alias(f"_z_{n}")]
    across = Window.partitionBy(*keys).orderBy("_bucket")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    after = across.rowsBetween(1, Window.unboundedFollowing)
    per_bucket = work.groupBy(*part).agg(*totals)
    for n in step_sum:
        per_bucket = per_bucket.withColumn(
            f"_e_{n}", holds(n, F.col(f"_a_{n}"), F.lag(f"_z_{n}").over(across))
        )
    carry = per_bucket.select(
        *part,
        *[F.lag(f"_t_{n}").over(across).alias(f"_c_{n}") for n in lag],
        *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in running_sum],
        *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in last_value],
        *[F.first(f"_t_{n}", ignorenulls=True).over(after).alias(f"_c_{n}") for n in next_value],
        *[
            (F.coalesce(F.sum(F.col(f"_t_{n}") + F.col(f"_e_{n}")).over(before), F.lit(0))
             + F.col(f"_e_{n}")).alias(f"_c_{n}")
            for n in step_sum
        ],
        F.count("*").over(Window.partitionBy(*keys)).alias("_buckets"),
    ).filter("_buckets > 1").drop("_buckets")

    local = work.select(
        "*",
        F.row_number().over(inside).alias("_rn"),
        *[F.lag(f"_v_{n}").over(inside).alias(f"_l_{n}") for n in lag],
        *[F.sum(f"_v_{n}").over(upto).alias(f"_l_{n}") for n in running_sum],
        *[F.last(f"_v_{n}", ignorenulls=True).over(upto).alias(f"_l_{n}") for n in last_value],
        *[F.first(f"_v_{n}", ignorenulls=True).over(onward).alias(f"_l_{n}") for n in next_value],
        *[F.sum(f"_h_{n}").over(upto).alias(f"_l_{n}") for n in step_sum],
    )
    joined = local.join(carry, part, "left")
    out = [F.col(c) for c in df.columns if c not in values]
    for n in lag:
        out.append(F.when(F.col("_rn") == 1, F.col(f"_c_{n}")).otherwise(F.col(f"_l_{n}")).alias(n))
    for n in [*running_sum, *step_sum]:
        total = F.col(f"_l_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0))
        out.append((total - 1 if n == position else total).alias(n))
    for n in [*last_value, *next_value]:
        out.append(F.coalesce(f"_l_{n}", f"_c_{n}").alias(n))
    return joined.select(*out)


def head_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group; each input partition keeps at most ``n`` per group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def head_tail_rows(df: DataFrame, keys: Sequence[str], order: str, max_rows: int) -> DataFrame:
    """Whole groups up to ``max_rows``; of longer ones the first and the last half.

    The two halves of a short group overlap and cover it, so no group is counted.
    """
    if max_rows % 2:
        raise ValueError("max_rows must be even")
    half = max_rows // 2
    ends = head_rows(df, keys, [F.col(order).asc()], half).unionByName(
        head_rows(df, keys, [F.col(order).desc()], half)
    )
    return ends.dropDuplicates([*keys, order])


def cut_by_rank(
    df: DataFrame,
    digits: Sequence[Column],
    order: Sequence[str],
    fractions: Sequence[float],
    labels: Sequence[str],
    label_col: str = "split",
) -> DataFrame:
    """Cut one global order at exact row counts ``floor(n * fraction)``.

    ``digits`` are columns of bounded range that spell out the beginning of ``order``, most
    significant first. A histogram over the first digit finds the cell that holds a cut, a
    histogram of that cell over the next digit a smaller one, and so on; the rows of the
    last cell are ranked. All this reads the order columns only. It gives the last row
    before each cut, and one pass over the rows compares them with it. ``fractions`` are
    the shares of all labels but the last; ``order`` must be unique and not NULL.
    """
    at = F.struct(*order)
    keys = df.select(*order, *[d.alias(f"_d{i}") for i, d in enumerate(digits)])
    # One row per cell: the range of the digit, not the number of rows, bounds this window.
    cells = keys.groupBy("_d0").agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy())
    marks, before = [], F.lit(0).cast("long")
    for i, share in enumerate(fractions):
        before = before + F.floor(total * F.lit(share)).cast("long")
        marks.append(F.struct(F.lit(i).alias("cut"), before.alias("mark")))
    w = Window.orderBy("_d0")
    held = cells.select(
        "_d0", (F.sum("_n").over(w) - F.col("_n")).alias("_lo"), "_n", F.array(*marks).alias("_m")
    ).select("_d0", "_lo", "_n", F.explode("_m").alias("_c"))
    last = F.col("_c.mark") - 1
    held = held.filter((last >= F.col("_lo")) & (last < F.col("_lo") + F.col("_n"))).select(
        F.col("_c.cut").alias("cut"), "_d0", (last - F.col("_lo")).alias("rest")
    )
    for level in range(1, len(digits)):
        seen = [f"_d{i}" for i in range(level)]
        digit = f"_d{level}"
        # At most one cell per cut.
        inner = keys.join(F.broadcast(held), seen).groupBy("cut", "rest", *seen, digit).agg(
            F.count("*").alias("_n")
        )
        w = Window.partitionBy("cut").orderBy(digit)
        inner = inner.withColumn("_lo", F.sum("_n").over(w) - F.col("_n"))
        held = inner.filter("rest >= _lo AND rest < _lo + _n").select(
            "cut", *seen, digit, (F.col("rest") - F.col("_lo")).alias("rest")
        )
    seen = [f"_d{i}" for i in range(len(digits))]
    w = Window.partitionBy("cut").orderBy(*order)
    found = keys.join(F.broadcast(held), seen).withColumn("_r", F.row_number().over(w) - 1)
    ends = found.filter("_r = rest").agg(
        *[F.max(F.when(F.col("cut") == i, at)).alias(f"c{i}") for i in range(len(fractions))]
    ).select(F.struct("*").alias("c")).scalar()
    out = None
    for i, name in enumerate(labels[:-1]):
        # Without a row before the cut nothing gets the label.
        inside = F.coalesce(at <= ends[f"c{i}"], F.lit(False))
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return df.withColumn(label_col, out.otherwise(labels[-1]))


def seeded_hash(key: Column, seed: int | str) -> Column:
    """Hex digest of a key and a seed: the same on every engine and partitioning."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def hash_digits(digest: Column) -> list[Column]:
    """Two digits of 4096 values each at the head of a hex digest."""
    return [F.substring(digest, 1, HASH_DIGITS), F.substring(digest, 1 + HASH_DIGITS, HASH_DIGITS)]


def long_digits(key: Column) -> list[Column]:
    """The upper three of the four 16-bit digits of a long, in the order of its values."""
    high = F.shiftright(key, 48)
    return [high, *[F.shiftright(key, n).bitwiseAND(0xFFFF) for n in (32, 16)]]
