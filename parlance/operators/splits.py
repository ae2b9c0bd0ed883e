"""Training splits, quality gates and augmentation plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.rows import explode_rows
from parlance.operators.ordering import cut_by_rank, hash_digits, long_digits, seeded_hash

# Split shares, quality gates, augmentation names.
TRAIN, VAL = 0.8, 0.1
SMALL_SET = 10
MIN_PROMPT, MIN_RESPONSE = 200, 500
SECTION_WORDS = ["SUBJECTIVE", "OBJECTIVE", "ASSESSMENT", "PLAN"]
AUGMENTATIONS = [
    "speed_slow", "speed_fast", "noise_light", "noise_heavy",
    "volume_up", "volume_down", "pitch_up", "pitch_down",
]
PER_CLIP = 3
# What each augmentation draws (rate, signal-to-noise in dB, gain in dB,
# semitones), from and to; rates have two digits.
DRAWS = {
    "speed_slow": (0.82, 0.92), "speed_fast": (1.08, 1.18), "noise_light": (28.0, 38.0),
    "noise_heavy": (15.0, 22.0), "volume_up": (2.0, 6.0), "volume_down": (-6.0, -2.0),
    "pitch_up": (1.0, 2.5), "pitch_down": (-2.5, -1.0),
}


def split_three_way(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Seeded shuffle, then floor(80 %) train, floor(10 %) val, the rest test."""
    hashed = df.withColumn("_h", seeded_hash(F.col(key), seed))
    return cut_by_rank(
        hashed, hash_digits(F.col("_h")), ["_h", key], [TRAIN, VAL], ["train", "val", "test"]
    ).drop("_h")


def split_two_way(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Seeded shuffle, floor(80 %) train, the rest val.

    Under ten rows all are train and the first one is val as well.
    """
    hashed = df.withColumn("_h", seeded_hash(F.col(key), seed))
    large = cut_by_rank(
        hashed, hash_digits(F.col("_h")), ["_h", key], [TRAIN], ["train", "val"]
    ).drop("_h")
    few = df.limit(SMALL_SET)
    n = few.agg(F.count("*").alias("n"))
    small = few.withColumn("split", F.lit("train")).unionByName(
        few.orderBy(key).limit(1).withColumn("split", F.lit("val"))
    )
    is_small = n.scalar() < SMALL_SET
    return large.filter(~is_small).unionByName(small.filter(is_small))


def split_sequential(df: DataFrame, key: str) -> DataFrame:
    """First max(1, floor(80 %)) rows in key order train, the rest val; a single row is both.

    ``key`` is a unique whole number.
    """
    # floor(0.8 n) is 0 only for n = 1, where the row is train and val alike.
    digits = long_digits(F.col(key).cast("long"))
    cut = cut_by_rank(df, digits, [key], [TRAIN], ["train", "val"])
    few = df.limit(2)
    only = few.agg(F.count("*").alias("n")).scalar() == 1
    return cut.unionByName(few.withColumn("split", F.lit("train")).filter(only))


def quality_filter(examples: DataFrame) -> DataFrame:
    """Long enough prompts and responses that name all four sections."""
    keep = (F.length("prompt") >= MIN_PROMPT) & (F.length("response") >= MIN_RESPONSE)
    for w in SECTION_WORDS:
        keep = keep & F.contains(F.upper("response"), F.lit(w))
    return examples.filter(keep)


def drawn_amount(key: Column, name: Column, seed: int = 42) -> Column:
    """How much of an augmentation a clip gets: even over its range, from a hash of the key."""
    share = F.conv(F.left(F.md5(F.concat_ws(":", key.cast("string"), name, F.lit(f"amount{seed}"))), F.lit(6)), 16, 10)
    out = None
    for n, (low, high) in DRAWS.items():
        value = F.lit(low) + share.cast("double") / 16.0**6 * F.lit(high - low)
        value = F.round(value, 2) if n.startswith("speed") else value
        out = F.when(name == n, value) if out is None else out.when(name == n, value)
    return out


def augmentation_plan(clips: DataFrame, key: str, per_clip: int = PER_CLIP, seed: int = 42,
                      names: list[str] = AUGMENTATIONS) -> DataFrame:
    """Train clips plus up to ``per_clip`` variants each, in seeded order; other splits as is.

    ``amount`` is what a variant draws, for ``waves.augment``.
    """
    ordered = F.transform(
        F.array_sort(
            F.array(*[
                F.struct(seeded_hash(F.col(key), f"{n}:{seed}").alias("h"), F.lit(n).alias("n"))
                for n in names
            ])
        ),
        lambda x: x["n"],
    )
    chosen = F.when(
        F.col("split") == "train",
        F.array_insert(F.slice(ordered, 1, per_clip), 1, F.lit(None).cast("string")),
    ).otherwise(F.array(F.lit(None).cast("string")))
    return explode_rows(clips, [F.col(c) for c in clips.columns], chosen, "augmented").withColumn(
        "file_name",
        F.when(
            F.col("augmented").isNotNull(),
            F.concat(F.regexp_replace("file_name", r"\.[^.]*$", ""), F.lit("_"), "augmented", F.lit(".wav")),
        ).otherwise(F.col("file_name")),
    ).withColumn("amount", drawn_amount(F.col(key), F.col("augmented"), seed))


def augmentation_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows per split before and after, and the multiplier."""
    b = before.groupBy("split").agg(F.count("*").alias("original"))
    a = after.groupBy("split").agg(F.count("*").alias("total"))
    return b.join(a, "split").withColumn("multiplier", F.round(F.col("total") / F.col("original"), 1))
