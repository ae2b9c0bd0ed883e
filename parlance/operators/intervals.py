"""Time-interval joins between speech chunks and diarisation segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import let
from parlance.operators.ordering import prefix

# Seconds per time bucket; about the length of a typical segment works best.
BUCKET_S = 60.0


# A node of the time tree spans so many of the next level; the levels reach over 10^14 buckets.
FANOUT, LEVELS = 256, 7
NODE = "array<struct<level:int,node:bigint>>"


def _cover(first: Column, last: Column) -> Column:
    """Tree nodes that make up the buckets ``first`` to ``last``, none of them twice.

    Each level keeps what its parents can't take whole, less than twice ``FANOUT`` nodes, so
    an interval of any length has few nodes; a short one has its buckets.
    """
    def run(a: Column, b: Column) -> Column:
        return F.when(a <= b, F.sequence(a, F.greatest(a, b))).otherwise(F.array().cast("array<bigint>"))

    def whole(ends: Column, level: Column) -> tuple[Column, Column]:
        span = F.pow(F.lit(FANOUT), level)
        return F.ceil(ends["first"] / span).cast("bigint"), F.floor((ends["last"] + 1) / span).cast("bigint") - 1

    def nodes(ends: Column, level: Column) -> Column:
        (a, b), (up, upto) = whole(ends, level), whole(ends, level + 1)
        inner = up <= upto
        left = run(a, F.when(inner, up * FANOUT - 1).otherwise(b))
        right = run(F.when(inner, (upto + 1) * FANOUT).otherwise(b + 1), b)
        return F.transform(F.concat(left, right), lambda n: F.struct(level.alias("level"), n.alias("node")))

    ends = F.struct(first.alias("first"), last.alias("last"))
    long = let(ends, lambda e: F.flatten(
        F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda level: nodes(e, level))
    ))
    short = F.transform(
        F.sequence(first, F.greatest(first, last)),
        lambda n: F.struct(F.lit(0).alias("level"), n.alias("node")),
    )
    return F.when(last - first < FANOUT, short).otherwise(long).cast(NODE)


def _placed(df: DataFrame, start: str, stop: str, width: float, flag: str) -> DataFrame:
    """One row per interval and place: the nodes of its cover, and at each level the node its
    start lies in. ``flag`` tells the two apart."""
    first, last = (F.floor(F.col(c) / width).cast("bigint") for c in (start, stop))
    levels = F.sequence(F.lit(0), F.lit(LEVELS - 1))

    def above(level: Column) -> Column:
        return F.floor(first / F.pow(F.lit(FANOUT), level)).cast("bigint")

    cover = F.transform(
        _cover(first, F.greatest(first, last)),
        lambda n: F.struct(n["level"].alias("level"), n["node"].alias("node"), F.lit(True).alias("covers")),
    )
    points = F.transform(
        levels, lambda n: F.struct(n.alias("level"), above(n).alias("node"), F.lit(False).alias("covers"))
    )
    places = F.when(first.isNotNull() & last.isNotNull(), F.concat(cover, points))
    return df.withColumn("_n", F.explode(places)).select(
        *df.columns, "_n.level", "_n.node", F.col("_n.covers").alias(flag)
    )


def overlap_pairs(chunks: DataFrame, segments: DataFrame, width: float = BUCKET_S) -> DataFrame:
    """Overlapping (chunk, segment) pairs through an equi-join on (session, tree node).

    Of two overlapping intervals one starts inside the other. The time line is a tree over
    buckets of ``width`` seconds; an interval is a few nodes of it, whatever its length, and
    a start lies in one node of each level. A pair is found once: with the chunk's start in
    the segment, or with the segment's later start in the chunk. An interval that stops
    before it starts overlaps nothing.
    """
    c = chunks.select("session_id", "chunk_id", "start_s", "end_s").filter("start_s <= end_s")
    s = segments.select(
        "session_id", "seg_id", "label",
        F.col("start_s").alias("seg_start"), F.col("end_s").alias("seg_end"),
    ).filter("seg_start <= seg_end")
    met = _placed(c, "start_s", "end_s", width, "_c").join(
        _placed(s, "seg_start", "seg_end", width, "_s"), ["session_id", "level", "node"]
    )
    later = (F.col("_s") & ~F.col("_c") & (F.col("start_s") >= F.col("seg_start"))) | (
        F.col("_c") & ~F.col("_s") & (F.col("seg_start") > F.col("start_s"))
    )
    both = met.filter(
        later & (F.col("start_s") < F.col("seg_end")) & (F.col("end_s") > F.col("seg_start"))
    )
    overlap = F.least("end_s", "seg_end") - F.greatest("start_s", "seg_start")
    return both.drop("level", "node", "_c", "_s").withColumn("overlap", overlap)


def assign_by_overlap(chunks: DataFrame, segments: DataFrame, width: float = BUCKET_S) -> DataFrame:
    """Label of the segment with the largest overlap, the earliest listed on a tie."""
    return (
        overlap_pairs(chunks, segments, width)
        .groupBy("session_id", "chunk_id")
        .agg(
            F.max_by("label", F.struct("overlap", -F.col("seg_id"))).alias("speaker"),
            F.max("overlap").alias("overlap"),
        )
    )


def assign_by_nearest(chunks: DataFrame, segments: DataFrame, width: float = BUCKET_S) -> DataFrame:
    """Label of the segment whose midpoint is nearest, the earliest listed on a tie.

    Chunks and segments share one timeline per session; the neighbours before and after
    each chunk come from one ordered pass over it, not from pairs.
    """
    mid = (F.col("start_s") + F.col("end_s")) / 2
    seg = F.struct(F.col("mid").alias("mid"), F.col("seg_id").alias("seg_id"),
                   F.col("label").alias("label"))
    points = (
        segments.withColumn("mid", mid)
        .groupBy("session_id", "mid")
        .agg(F.min_by("label", "seg_id").alias("label"), F.min("seg_id").alias("seg_id"))
        .select("session_id", "mid", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("chunk_id"),
                seg.alias("seg"))
    )
    line = points.unionByName(
        chunks.select("session_id", mid.alias("mid"), F.lit(1).alias("kind"),
                      F.col("chunk_id").cast("long").alias("chunk_id"),
                      F.lit(None).cast(points.schema["seg"].dataType).alias("seg"))
    )
    both = prefix(
        line, ["session_id"], ["mid", "kind", "chunk_id"], F.floor(F.col("mid") / width),
        last_value={"_before": F.col("seg")}, next_value={"_after": F.col("seg")},
    )

    def distance(side: str) -> Column:
        return F.struct(
            F.abs(F.col(f"{side}.mid") - F.col("mid")).alias("d"),
            F.col(f"{side}.seg_id").alias("seg_id"),
        )

    use_before = F.col("_after").isNull() | (
        F.col("_before").isNotNull() & (distance("_before") <= distance("_after"))
    )
    return both.filter("kind = 1").select(
        "session_id", "chunk_id",
        F.when(use_before, F.col("_before.label")).otherwise(F.col("_after.label")).alias("speaker"),
    )


def assign_speakers(chunks: DataFrame, segments: DataFrame, width: float = BUCKET_S) -> DataFrame:
    """Overlap decides; chunks without any take the nearest segment."""
    key = ["session_id", "chunk_id"]
    hit = assign_by_overlap(chunks, segments, width).select(*key, F.col("speaker").alias("_hit"))
    met = chunks.drop("speaker").join(hit, key, "left")
    missed = met.filter("_hit IS NULL").select(*key, "start_s", "end_s")
    near = assign_by_nearest(missed, segments, width).withColumnRenamed("speaker", "_near")
    return met.join(near, key, "left").withColumn("speaker", F.coalesce("_hit", "_near")).drop("_hit", "_near")
