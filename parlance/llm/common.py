"""Helpers the training-data operators share."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Hashable
from functools import wraps
from types import ModuleType
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.session import settle

T = TypeVar("T")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Name of the row number the operators carry inside; it never leaves them.
ROW = "__row"


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def numbered(df: DataFrame) -> DataFrame:
    """The table with a number per row, written once to the shared folder.

    How files are dealt to tasks follows the cores that are there when a job is planned, and
    what comes out of a shuffle may come in another order, so a number made anew in a later
    job may be that of another row. Here it is a column. Null or repeated ids never mix
    rows up.
    """
    return settle(df.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def free_name(name: str, taken: list[str]) -> str:
    """``name``, longer by as many underscores as it takes to be none of those given."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def keeps_columns(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Lets an operator's table have a column of the name its row numbers go by."""

    @wraps(operator)
    def run(df: DataFrame, *args, **options) -> DataFrame:
        aside = {c: free_name(c, df.columns) for c in df.columns if c.lower() == ROW}
        found = operator(df.withColumnsRenamed(aside), *args, **options)
        return found.withColumnsRenamed({new: old for old, new in aside.items()})

    return run


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: one number, for sizing partitions."""
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def parts_for(df: DataFrame, size: int, target: int = 64 << 20) -> int:
    """Partitions of about ``target`` bytes, never fewer than the session's setting."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // target))


def per_worker(key: Hashable, make: Callable[[], T]) -> T:
    """One value per Python worker process, made when it is first asked for.

    Workers live on from task to task, but the package's functions are shipped anew with
    each, and their globals with them; so the value is kept with the process's modules.
    """
    held = sys.modules.setdefault("_parlance_worker", ModuleType("_parlance_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def release() -> None:
    """Gives memory that is free but still held by a worker back to the system.

    Workers live on between tasks, and what one has held at its peak would otherwise stay
    with it while others work.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Codes(dict):
    """Strings to dense numbers; ``fresh`` lists what has not been looked at yet."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = code = len(self)
        self.fresh.append(key)
        return code

    def encode(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def take(self) -> list[str]:
        fresh, self.fresh = self.fresh, []
        return fresh


class Growing:
    """A numpy array that is appended to."""

    def __init__(self, dtype, width: int | None = None) -> None:
        self.shape = () if width is None else (width,)
        self.data, self.n = np.empty((1024, *self.shape), dtype), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            grown = np.empty((2 * (self.n + len(more)), *self.shape), self.data.dtype)
            grown[: self.n] = self.data[: self.n]
            self.data = grown
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)

    def view(self) -> np.ndarray:
        return self.data[: self.n]


def spread_index(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """``concatenate([arange(s, s + n) for s, n in zip(starts, lens)])``."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lens) - lens
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lens)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all its bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def window_hash(seq: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` values, built from windows of powers of two."""
    n = len(seq) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, step = None, 0, seq, 1
    while True:
        if width & step:
            part = power[done : done + n]
            out = part if out is None else mix64(out * K1 + part * K2)
            done += step
        if done == width:
            return mix64(out ^ np.uint64(width))
        power = mix64(power[:-step] * K1 + power[step:] * K2)
        step *= 2
