"""Which of a great many hashed keys occur more than once.

Tasks send their keys in packed arrays to buckets by hash, a bucket sorts what it gets and
answers. A task answers for itself what repeats within a batch, and sends each key once
per batch, so a key found everywhere adds one record per batch to its bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from parlance.llm.common import ROW, mix64, release

NO_ANSWER = -1
# Rows whose keys are asked about together.
ASKED_ROWS = 5000
PACKED = "bucket int, keys binary, refs binary, places binary"


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal values."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return first, np.diff(np.append(first, len(sorted_keys)))


def _ordered(keys: np.ndarray, check: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of keys, and the first index and length of each run of equal ones in it."""
    if check is None:
        order = np.argsort(keys, kind="stable")
        return order, *runs(keys[order])
    order = np.lexsort((check, keys))
    a, b = keys[order], check[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, len(a)))


def questions(
    keys: np.ndarray, refs: np.ndarray, places: np.ndarray, buckets: int, most: int = 1,
    check: np.ndarray | None = None,
) -> tuple[np.ndarray, pd.DataFrame]:
    """Which keys occur over ``most`` times in one batch, and the packed rows for the rest.

    A key that occurs up to ``most`` times is sent with its ``refs`` (int64) and ``places``
    (int32), which come back with the answer; one that occurs oftener is sent once. With a
    second hash in ``check``, keys are equal if both are.
    """
    order, first, n = _ordered(keys, check)
    often = n > most
    known = np.zeros(len(keys), bool)
    known[order] = np.repeat(often, n)
    sent = np.ones(len(keys), bool)
    sent[known] = False
    sent[order[first[often]]] = True
    keys, ref, place = keys[sent], np.where(known, NO_ANSWER, refs)[sent], places[sent]
    told = keys if check is None else np.column_stack([keys, check[sent]])
    bucket = (mix64(keys) % np.uint64(buckets)).astype(np.int32)
    # Inside a bucket in the order of refs, which packs well.
    by = np.lexsort((ref, bucket))
    start, size = runs(bucket[by])
    rows = []
    for a, k in zip(start, size):
        own = by[a : a + k]
        rows.append((
            int(bucket[own[0]]), told[own].tobytes(), ref[own].astype(np.int64).tobytes(),
            place[own].astype(np.int32).tobytes(),
        ))
    return known, pd.DataFrame(rows, columns=["bucket", "keys", "refs", "places"])


def answers(
    packed: pd.DataFrame, crowd: int = 0, checked: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Refs and places, by ref and place, of the keys of one bucket that repeat.

    The third array tells which of them belong to a key that some batch sent for many, or
    that came over ``crowd`` times. ``checked`` keys come with a second hash.
    """
    keys, check = np.frombuffer(b"".join(packed["keys"]), np.uint64), None
    if checked:
        keys, check = (np.ascontiguousarray(k) for k in keys.reshape(-1, 2).T)
    refs = np.frombuffer(b"".join(packed["refs"]), np.int64)
    places = np.frombuffer(b"".join(packed["places"]), np.int32)
    order, first, n = _ordered(keys, check)
    many = refs[order] == NO_ANSWER
    held = np.maximum.reduceat(many, first) if len(first) else np.zeros(0, bool)
    again = order[np.repeat((n > 1) | held, n)]
    crowded = np.repeat(((n > crowd) | held)[(n > 1) | held], n[(n > 1) | held])
    wanted = refs[again] != NO_ANSWER
    again, crowded = again[wanted], crowded[wanted]
    by = np.lexsort((places[again], refs[again]))
    return refs[again[by]], places[again[by]], crowded[by]


GROUPED = "part int, refs binary, x binary, y binary"


def part_of(refs: np.ndarray, parts: int) -> np.ndarray:
    """The part of the answers a row number belongs to."""
    return (mix64(refs.astype(np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int32)


def grouped(refs: np.ndarray, x: np.ndarray, y: np.ndarray, parts: int) -> pd.DataFrame:
    """Values of many rows packed by a hash of the row, so that a bucket's answer is a few
    rows however many it is about."""
    part = part_of(refs, parts)
    by = np.lexsort((refs, part))
    first, n = runs(part[by])
    rows = [
        (int(part[by[a]]), *(c[by[a : a + k]].astype(np.int64).tobytes() for c in (refs, x, y)))
        for a, k in zip(first, n)
    ]
    return pd.DataFrame(rows, columns=["part", "refs", "x", "y"])


def per_row(packed: DataFrame) -> DataFrame:
    """One row per row number with all its values, out of ``grouped`` rows."""

    def unpack(group: pd.DataFrame) -> pd.DataFrame:
        refs, x, y = (
            np.frombuffer(b"".join(group[c]), np.int64) for c in ("refs", "x", "y")
        )
        by = np.argsort(refs, kind="stable")
        refs, x, y = refs[by], x[by], y[by]
        first, n = runs(refs)
        rows = [
            (int(refs[a]), x[a : a + k].tobytes(), y[a : a + k].tobytes())
            for a, k in zip(first, n)
        ]
        return pd.DataFrame(rows, columns=[ROW, "x", "y"])

    return packed.groupBy("part").applyInPandas(unpack, f"{ROW} long, x binary, y binary")


def repeated_places(
    rows: DataFrame,
    keys_of: Callable[[], Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray, np.ndarray]]],
    buckets: int,
    most: int,
    crowd: int,
) -> DataFrame:
    """Places of repeated keys per row, packed: ``x`` place, ``y`` whether the key is crowded.

    ``keys_of`` runs once per task and gives a function from a batch to the keys in it,
    the row numbers they are from and their places there. A key is crowded if it occurs
    over ``most`` times in some batch or comes in over ``crowd`` records; every place it
    has learns the same. Rows without a repeated key do not come back.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = keys_of()
        for batch in (b.iloc[i : i + ASKED_ROWS] for b in batches for i in range(0, len(b), ASKED_ROWS)):
            keys, refs, places = read(batch)
            known, asked = questions(keys, refs, places, buckets, most)
            yield asked.assign(own=None)
            own = np.column_stack([refs[known], places[known]])
            if len(own):
                # What is known already travels along, so the rows are read once.
                yield pd.DataFrame({
                    "bucket": [int(refs[0] % buckets)], "keys": [b""], "refs": [b""],
                    "places": [b""], "own": [own.astype(np.int64).tobytes()],
                })
        release()

    def answer(packed: pd.DataFrame) -> pd.DataFrame:
        refs, places, crowded = answers(packed, crowd)
        own = np.frombuffer(b"".join(x for x in packed["own"] if x), np.int64).reshape(-1, 2)
        refs = np.concatenate([refs, own[:, 0]])
        places = np.concatenate([places, own[:, 1]]).astype(np.int64)
        crowded = np.concatenate([crowded, np.ones(len(own), bool)])
        return grouped(refs, places, crowded, buckets)

    asked = rows.mapInPandas(ask, PACKED + ", own binary")
    return per_row(asked.groupBy("bucket").applyInPandas(answer, GROUPED))
