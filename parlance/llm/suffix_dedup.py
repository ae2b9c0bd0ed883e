"""Repeated byte strings across documents, by merged Burrows-Wheeler transforms.

Sampled anchors bring together the places that could hold the same string; the transforms
of the text around them are merged, and the intervals of suffixes with a long common
prefix are the strings that repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm import bwt, repeats
from parlance.llm.common import (
    ROW, mix64, numbered, parts_for, spread_index, text_bytes,
)
from parlance.llm.words import text_slices
from parlance.session import free_shuffles, settle

LENGTH = 200
# Bytes of an anchor. Every string of LENGTH bytes holds the anchor with the least hash in it.
ANCHOR = 48
# An anchor found oftener than this in a batch, or in more records than CROWD, is crowded.
MOST, CROWD = 16, 4096
# Bytes of text whose transforms are merged together, and of one transform.
MERGED, SHARD = 1 << 19, 1 << 17
# Odd multipliers of two hashes of the same bytes.
BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def gram_hashes(flat: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """Hash of every ``width`` bytes, from hashes of powers of two."""
    n = len(flat) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, step, out, done = flat.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if width & step:
            part = power[done : done + n]
            factor = np.uint64(pow(base, step, 1 << 64))
            out = part.copy() if out is None else out * factor + part
            done += step
        if done == width:
            return mix64(out)
        power = power[:-step] * np.uint64(pow(base, step, 1 << 64)) + power[step:]
        step *= 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, from running minima of blocks."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate((x, np.full(pad, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, width)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(onward[:n], upto[width - 1 : width - 1 + n])


def anchors(flat: np.ndarray, sizes: np.ndarray, length: int, anchor: int):
    """Anchors of texts in a row: hash, place, and the first and last string each one stands
    for. Every string of ``length`` bytes inside a text belongs to exactly one anchor, at
    the same distance wherever the string occurs."""
    none = np.zeros(0, np.int64)
    if len(flat) < length:
        return np.zeros(0, np.uint64), none, none, none
    hashes = gram_hashes(flat, anchor)
    bits = np.uint64(max(1, int(len(flat)).bit_length()))
    spots = np.arange(len(hashes), dtype=np.uint64)
    least = sliding_min((hashes >> bits << bits) | spots, length - anchor + 1)
    starts = spread_index(np.cumsum(sizes) - sizes, np.maximum(sizes - length + 1, 0))
    if not len(starts):
        return np.zeros(0, np.uint64), none, none, none
    spot = (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first, n = repeats.runs(spot)
    spot = spot[first]
    return hashes[spot], spot, starts[first], starts[first + n - 1]


def _batches(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Bytes, sizes, first bytes of the texts of each slice of a batch, and its first row."""
    texts = batch["body"].tolist()
    for a, b in text_slices(texts):
        sizes = np.fromiter(map(len, texts[a:b]), np.int64, b - a)
        flat = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        yield flat, sizes, np.cumsum(sizes) - sizes, a


def _packed(values: np.ndarray, dtype) -> bytes:
    return values.astype(dtype).tobytes()


def _squeezed(texts: list[bytes]) -> bytes:
    """Texts in a row as they travel: Spark's own packing of shuffles leaves half as much again."""
    return pa.Codec("zstd", compression_level=3).compress(b"".join(texts), asbytes=True)


def _unsqueezed(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)


def _spots(read: DataFrame, size: int, length: int, anchor: int) -> DataFrame:
    """Places of repeated anchors per row."""

    def keys_of():
        def read_batch(batch: pd.DataFrame):
            rows = batch[ROW].to_numpy(np.int64)
            held = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for flat, sizes, heads, at in _batches(batch):
                keys, spot, _, _ = anchors(flat, sizes, length, anchor)
                doc = np.searchsorted(heads, spot, "right") - 1
                held.append((keys, rows[at + doc], spot - heads[doc]))
            return tuple(np.concatenate(x) for x in zip(*held))

        return read_batch

    return repeats.repeated_places(read, keys_of, parts_for(read, size // 4), MOST, CROWD)


def _pieces(spotted: DataFrame, buckets: int, length: int, anchor: int) -> DataFrame:
    """What the repeated anchors of each row stand for, on its way to where it meets its like.

    An anchor's strings travel as one piece of text to the anchor's bucket. Crowded anchors
    would bring too many pieces to one place; each of their strings travels as two hashes of
    64 bits instead, to a bucket of its own, which only strings with the first hash share.
    """
    columns = ["bucket", "keys", "refs", "places", "widths", "content", "own"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch[ROW].to_numpy(np.int64)
            done = [np.zeros((0, 3), np.int64)]
            none = np.zeros(0, np.int64)
            singles = [(np.zeros(0, np.uint64), none, none, np.zeros(0, np.uint64))]
            parts = []
            for flat, sizes, heads, at in _batches(batch):
                keys, spot, lo, hi = anchors(flat, sizes, length, anchor)
                mark = np.zeros(len(flat) + 1, np.int8)
                for i, head in enumerate(heads):
                    x, y = (np.frombuffer(batch[c].iat[at + i], np.int64) for c in "xy")
                    mark[head + x] = 1 + y
                kind = mark[spot]
                doc = np.searchsorted(heads, lo, "right") - 1

                many = kind == 2
                if many.any():
                    starts = spread_index(lo[many], hi[many] - lo[many] + 1)
                    owner = np.repeat(doc[many], hi[many] - lo[many] + 1)
                    first, second = (gram_hashes(flat, length, b)[starts] for b in (BASE, SECOND_BASE))
                    singles.append((first, rows[at + owner], starts - heads[owner], second))

                few = kind == 1
                if few.any():
                    parts.append((
                        keys[few], rows[at + doc[few]], lo[few] - heads[doc[few]],
                        hi[few] - lo[few] + length,
                        [flat[a : b + length].tobytes() for a, b in zip(lo[few], hi[few])],
                    ))
            strings, refs, places, second = (np.concatenate(x) for x in zip(*singles))
            known, asked = repeats.questions(strings, refs, places, buckets, check=second)
            refs, places = refs[known], places[known]
            by = np.lexsort((places, refs))
            done.append(_joined(refs[by], places[by], length))
            if len(asked):
                # Strings have buckets of their own, behind those of the pieces.
                asked["bucket"] += buckets
                yield asked.assign(widths=None, content=None, own=None)[columns]
            if parts:
                kept, sent = _share(parts, buckets)
                done.append(kept)
                yield sent.assign(own=None)[columns]
            done = np.concatenate(done)
            if len(done):
                yield pd.DataFrame([(
                    int(rows[0] % buckets), b"", b"", b"", None, None, done.tobytes()
                )], columns=columns)

    return spotted.mapInPandas(cut, repeats.PACKED + ", widths binary, content binary, own binary")


def _share(parts: list, buckets: int) -> tuple[np.ndarray, pd.DataFrame]:
    """Pieces of a batch: those with equal text repeat, and their text is sent once."""
    keys, refs, places, widths = (np.concatenate(x) for x in list(zip(*parts))[:4])
    content = [c for p in parts for c in p[4]]
    numbers: dict[bytes, int] = {}
    names = np.fromiter((numbers.setdefault(c, len(numbers)) for c in content), np.int64, len(content))
    order = np.argsort(names, kind="stable")
    first, n = repeats.runs(names[order])
    twice = np.zeros(len(keys), bool)
    twice[order] = np.repeat(n > 1, n)
    kept = np.column_stack([refs, places, places + widths])[twice]
    at = order[first]
    refs = np.where(n > 1, repeats.NO_ANSWER, refs[at])
    bucket = (mix64(keys[at]) % np.uint64(buckets)).astype(np.int64)
    by = np.lexsort((refs, bucket))
    start, size = repeats.runs(bucket[by])
    rows = []
    for a, k in zip(start, size):
        own = by[a : a + k]
        rows.append((
            int(bucket[own[0]]), _packed(keys[at[own]], np.uint64), _packed(refs[own], np.int64),
            _packed(places[at[own]], np.int32), _packed(widths[at[own]], np.int32),
            _squeezed([content[i] for i in at[own]]),
        ))
    names = ["bucket", "keys", "refs", "places", "widths", "content"]
    return kept.astype(np.int64), pd.DataFrame(rows, columns=names)


def _joined(refs: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """(ref, from, to) of the bytes covered by strings at ordered places."""
    if not len(refs):
        return np.zeros((0, 3), np.int64)
    new = np.ones(len(refs), bool)
    new[1:] = (refs[1:] != refs[:-1]) | (places[1:] > places[:-1] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(refs)) - 1
    return np.column_stack([refs[first], places[first], places[last] + length]).astype(np.int64)


def _meet(packed: pd.DataFrame, length: int) -> np.ndarray:
    """(ref, from, to) of what repeats among the pieces of one bucket."""
    keys = np.frombuffer(b"".join(packed["keys"]), np.uint64)
    refs = np.frombuffer(b"".join(packed["refs"]), np.int64)
    places = np.frombuffer(b"".join(packed["places"]), np.int32).astype(np.int64)
    widths = np.frombuffer(b"".join(packed["widths"]), np.int32).astype(np.int64)
    sizes = (int(np.frombuffer(w, np.int32).sum(dtype=np.int64)) for w in packed["widths"])
    flat = b"".join(map(_unsqueezed, packed["content"], sizes))
    ends = np.cumsum(widths)
    texts: dict[bytes, int] = {}
    piece = np.empty(len(keys), np.int64)
    for i, (a, b) in enumerate(zip((ends - widths).tolist(), ends.tolist())):
        piece[i] = texts.setdefault(flat[a:b], len(texts))
    held = list(texts)
    times = np.bincount(piece, 1 + (refs == repeats.NO_ANSWER), len(held))
    key = np.empty(len(held), np.uint64)
    key[piece] = keys
    whole = times > 1

    # Texts of one anchor are compared; an anchor with a single text has nothing to meet.
    order = np.argsort(key, kind="stable")
    first, n = repeats.runs(key[order])
    found: dict[int, np.ndarray] = {}
    group: list[int] = []
    size = 0
    for a, k in zip(first, n):
        if k > 1:
            own = order[a : a + k].tolist()
            group += own
            size += sum(len(held[i]) for i in own)
            if size >= MERGED:
                found.update(_repeated([held[i] for i in group], group, length))
                group, size = [], 0
    if group:
        found.update(_repeated([held[i] for i in group], group, length))

    out = [np.zeros((0, 3), np.int64)]
    ask = refs != repeats.NO_ANSWER
    full = ask & whole[piece]
    out.append(np.column_stack([refs, places, places + widths])[full])
    for i in np.flatnonzero(ask & ~whole[piece]):
        starts = found.get(int(piece[i]))
        if starts is not None and len(starts):
            out.append(_joined(np.full(len(starts), refs[i]), places[i] + starts, length))
    return np.concatenate(out).astype(np.int64)


def _repeated(texts: list[bytes], names: list[int], length: int) -> dict[int, np.ndarray]:
    """Per text, where strings of ``length`` bytes start that also start elsewhere."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    parts, base, i = [], 0, 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and (held < SHARD or j == i):
            held += len(texts[j])
            j += 1
        flat = np.frombuffer(b"".join(texts[i:j]), np.uint8)
        parts.append(bwt.transform(flat, sizes[i:j], base))
        base, i = base + held + j - i, j
    merged = bwt.merge_all(parts)
    level = bwt.repeated_intervals(merged, length)
    heads = np.cumsum(sizes + 1) - sizes - 1
    text = np.searchsorted(heads, merged.place, "right") - 1
    at = merged.place - heads[text]
    real = at + length <= sizes[text]
    level, text, at = level[real], text[real], at[real]
    _, n = repeats.runs(level)
    again = np.repeat(n > 1, n)
    text, at = text[again], at[again]
    by = np.lexsort((at, text))
    text, at = text[by], at[by]
    first, n = repeats.runs(text)
    return {names[int(text[a])]: at[a : a + k] for a, k in zip(first, n)}


def repeated_spans(
    docs: DataFrame, text: str = "text", length: int = LENGTH, anchor: int = ANCHOR
) -> DataFrame:
    """Per row with any: row number, and packed starts ``x`` and ends ``y`` of repeated bytes.

    Spans of one row may touch or overlap.
    """
    rows = numbered(docs.select(text))
    return _spans(_bodies(rows, text), text_bytes(rows, text), length, anchor)


def _bodies(rows: DataFrame, text: str, *more: Column) -> DataFrame:
    """Number and UTF-8 bytes of ``numbered`` rows, and ``more`` of them."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    # An inner join would ask for numbers that are not null, and its shuffle be another one.
    return rows.where(F.col(ROW).isNotNull()).select(ROW, *more, body.alias("body"))


def _spans(read: DataFrame, size: int, length: int, anchor: int) -> DataFrame:
    """``repeated_spans`` of ``_bodies`` of ``size`` bytes. All columns of ``read`` go through
    its one join, so another join of the same ``read`` by row takes the same shuffle."""
    body = read.select(ROW, "body")
    spots = settle(_spots(body, size, length, anchor), "spots")
    free_shuffles(read.sparkSession)
    buckets = parts_for(read, size)

    def meet(packed: pd.DataFrame) -> pd.DataFrame:
        own = np.frombuffer(b"".join(x for x in packed["own"] if x), np.int64).reshape(-1, 3)
        packed = packed[packed["keys"].str.len() > 0]
        if len(packed) and packed["widths"].iat[0] is None:
            refs, places, _ = repeats.answers(packed, checked=True)
            met = _joined(refs, places.astype(np.int64), length)
        else:
            met = _meet(packed, length)
        met = np.concatenate([own, met])
        return repeats.grouped(*(np.ascontiguousarray(met[:, i]) for i in range(3)), buckets)

    cut = _pieces(read.join(spots, ROW), buckets, length, anchor)
    return repeats.per_row(cut.groupBy("bucket").applyInPandas(meet, repeats.GROUPED))


def drop_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    anchor: int = ANCHOR,
    with_text: bool = True,
) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``
    and, if asked for, ``kept`` (the bytes left, as binary: a cut may fall inside a letter).

    A byte is removed if a string of ``length`` bytes that covers it also starts at another
    place, in the same text or another; strings never cross texts and are judged on the
    input. Texts are read as UTF-8, null counts as empty, texts shorter than ``length``
    stay whole. Rows that repeat are texts like others, so both lose what they share.
    Other columns are ignored, an empty table gives an empty table.
    """
    rows = numbered(docs.select(*dict.fromkeys([id_col, text])))
    read = _bodies(rows, text, F.col(id_col).alias("id"))
    # Not settled: in one job with the join below, the texts are shuffled once for both.
    spans = _spans(read, text_bytes(rows, text), length, anchor)
    fields = [read.schema["id"]]
    fields += [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    fields.append(T.StructField("kept_sha256", T.StringType()))
    if with_text:
        fields.append(T.StructField("kept", T.BinaryType()))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for body, x, y in zip(batch["body"], batch["x"], batch["y"]):
                removed = n = 0
                if x is not None:
                    edge = np.zeros(len(body) + 1, np.int32)
                    np.add.at(edge, np.frombuffer(x, np.int64), 1)
                    np.add.at(edge, np.frombuffer(y, np.int64), -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed = int(gone.sum())
                    n = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
                else:
                    kept = bytes(body)
                row = (len(body), removed, n, hashlib.sha256(kept).hexdigest())
                rows.append((*row, kept) if with_text else row)
            out = pd.DataFrame(rows, columns=[f.name for f in fields[1:]])
            out.insert(0, "id", batch["id"].to_numpy())
            yield out

    done = read.join(spans, ROW, "left").drop(ROW).mapInPandas(finish, T.StructType(fields))
    return done.withColumnRenamed("id", id_col)
