"""Waveforms held as ARRAY<FLOAT>: levels, durations, windows, resampling, noise."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.rows import explode_rows
from parlance.functions.text import let, valid_clip_text

# Sample rate, clip length limits, peak level, window layout (seconds).
SAMPLE_RATE, MIN_S, MAX_S, PEAK = 16000, 1.0, 30.0, 0.95
WINDOW_S, OVERLAP_S, MIN_TAIL_S = 28, 1, 0.5


def peak_normalise(wave: Column) -> Column:
    top = F.array_max(F.transform(wave, lambda x: F.abs(x.cast("double"))))
    return let(
        top,
        lambda p: F.when(p > 0, F.transform(wave, lambda x: x.cast("double") / p * PEAK))
        .otherwise(F.transform(wave, lambda x: x.cast("double"))),
    )


def duration_s(wave: Column, rate: int = SAMPLE_RATE) -> Column:
    return F.size(wave) / F.lit(rate)


def skip_reason(transcript: Column, found: Column, seconds: Column,
                low: float = MIN_S, high: float = MAX_S) -> Column:
    """Why a clip is left out, NULL when it is kept."""
    return (
        F.when(~valid_clip_text(transcript), "bad_transcript")
        .when(~found, "not_found")
        .when(seconds < low, "too_short")
        .when(seconds > high, "too_long")
    )


def gain_clip(wave: Column, gain_db: float | Column) -> Column:
    factor = F.pow(F.lit(10.0), (gain_db if isinstance(gain_db, Column) else F.lit(float(gain_db))) / 20)
    return F.transform(
        wave, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double") * factor))
    )


def windows(clips: DataFrame, key: str, wave: str, rate: int = SAMPLE_RATE,
            window_s: float = WINDOW_S, overlap_s: float = OVERLAP_S, min_tail_s: float = MIN_TAIL_S) -> DataFrame:
    """Overlapping windows; a window shorter than ``min_tail_s`` is dropped."""
    size, step = int(window_s * rate), int((window_s - overlap_s) * rate)
    n = F.size(wave)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    cut = explode_rows(clips, [key, wave], starts, "_at", "chunk_id")
    return (
        cut.withColumn("samples", F.slice(wave, F.col("_at") + 1, size))
        .filter(F.size("samples") / rate >= min_tail_s)
        .select(
            key, "chunk_id", (F.col("_at") / rate).alias("start_s"),
            ((F.col("_at") + F.size("samples")) / rate).alias("end_s"), "samples",
        )
    )


def resample(wave: Column, n_out: Column) -> Column:
    """Linear interpolation onto ``n_out`` evenly spaced points from first to last sample."""

    def build(b: Column) -> Column:
        n, m = F.size(b["w"]), b["m"]

        def at(i: Column) -> Column:
            pos = F.when(m > 1, i * (n - 1) / (m - 1)).otherwise(F.lit(0.0))
            lo = F.least(F.floor(pos).cast("int"), n - 1)
            hi = F.least(lo + 1, n - 1)
            a, z = F.get(b["w"], lo), F.get(b["w"], hi)
            return a + (z - a) * (pos - lo)

        return F.when(m > 0, F.transform(F.sequence(F.lit(0), m - 1), at)).otherwise(
            F.array().cast("array<double>")
        )

    wide = F.transform(wave, lambda x: x.cast("double"))
    return let(F.struct(wide.alias("w"), n_out.cast("int").alias("m")), build)


def change_speed(wave: Column, rate: float | Column) -> Column:
    return resample(wave, F.floor(F.size(wave) / (rate if isinstance(rate, Column) else F.lit(float(rate)))))


def change_rate(wave: Column, rate: int, target: int = SAMPLE_RATE) -> Column:
    return resample(wave, F.floor(F.size(wave) * F.lit(target) / F.lit(rate)))


def shift_pitch(wave: Column, semitones: float | Column) -> Column:
    """Resample to change pitch, then back to the original length."""
    if isinstance(semitones, Column):
        factor = F.pow(F.lit(2.0), -semitones / 12)
    else:
        factor = F.lit(2 ** (-semitones / 12))
    return let(
        F.struct(resample(wave, F.floor(F.size(wave) * factor)).alias("s"), F.size(wave).alias("n")),
        lambda b: resample(b["s"], b["n"]),
    )


def add_noise(clips: DataFrame, key: str, wave: str, snr_db: float | Column, seed: int = 42) -> DataFrame:
    """Gaussian noise at a signal-to-noise ratio, drawn from the clip's own key; a clip
    whose ratio is NULL stays as it is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, samples, ratio in zip(pdf["_seed"], pdf[wave], pdf["_snr"]):
                x = np.asarray(samples, dtype=np.float64)
                power = float(np.mean(x**2)) if len(x) else 0.0
                if power and ratio == ratio and ratio is not None:
                    rng = np.random.default_rng(k & 0x7FFFFFFFFFFFFFFF)
                    x = x + rng.normal(0, np.sqrt(power / 10 ** (ratio / 10)), len(x))
                out.append(x.astype(np.float32))
            yield pd.DataFrame({key: pdf[key], wave: out})

    kind = clips.schema[key].dataType.simpleString()
    return (
        clips.select(
            key, wave, F.xxhash64(F.col(key), F.lit(seed)).alias("_seed"),
            (snr_db if isinstance(snr_db, Column) else F.lit(float(snr_db))).alias("_snr"),
        )
        .mapInPandas(run, f"{key} {kind}, {wave} array<float>")
    )


def augment(clips: DataFrame, key: str, wave: str, name: str = "augmented", amount: str = "amount",
            seed: int = 42) -> DataFrame:
    """``key`` (unique per variant) and the waveform after its augmentation; none for a NULL name."""
    kind, by = F.col(name), F.col(amount)
    plain = F.transform(wave, lambda x: x.cast("double"))
    changed = (
        F.when(kind.startswith("speed"), change_speed(F.col(wave), by))
        .when(kind.startswith("volume"), gain_clip(F.col(wave), by))
        .when(kind.startswith("pitch"), shift_pitch(F.col(wave), by))
        .otherwise(plain)
    )
    ratio = F.when(kind.startswith("noise"), by)
    return add_noise(clips.select(key, name, amount, changed.alias(wave)), key, wave, ratio, seed)


def clip_stats(clips: DataFrame, reason: str = "skip_reason") -> DataFrame:
    """Per language and outcome: clips, minutes and mean length."""
    return clips.groupBy("language", F.coalesce(reason, F.lit("kept")).alias("outcome")).agg(
        F.count("*").alias("clips"),
        F.round(F.sum("duration_s") / 60, 6).alias("minutes"),
        F.round(F.avg("duration_s"), 6).alias("avg_duration_s"),
    )
