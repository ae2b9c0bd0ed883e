"""Documents into sequences of equal length and even attention cost."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import Growing, per_worker, spread_index
from parlance.llm.words import KEPT_CHUNKS, MARKS, PLAIN_SAMPLES, ChunkTable, byte_letters, plain_word, text_slices

# Weight of a token pair against a token in the cost of attention over a piece.
PAIR_COST = 1 / 1024
# Tokens packed together: 256 sequences of 4096.
GROUP_TOKENS = 1 << 20


def attention_cost(tokens: np.ndarray | int) -> np.ndarray | float:
    """Estimated cost of a piece that attends to itself: linear and quadratic part."""
    return tokens + PAIR_COST * tokens * tokens


def pack_group(
    sizes: np.ndarray, capacities: np.ndarray
) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; all capacities get filled.

    ``sizes`` add up to ``capacities``. Whole sequences are cut off long documents first.
    What is left goes, largest first, to the sequence of lowest cost among those it fits
    into; if it fits into none, the sequence of lowest cost with room takes what it can
    hold and the rest goes on.
    """
    room, cost = capacities.astype(np.int64), np.zeros(len(capacities))
    out: list[tuple[int, int, int, int, int]] = []
    full = int(capacities.max(initial=0))
    free = list(np.flatnonzero(capacities == full)[::-1])
    left = []
    for doc, size in enumerate(sizes.tolist()):
        start = 0
        while size - start >= full > 0 and free:
            seq = int(free.pop())
            out.append((doc, start, full, seq, 0))
            room[seq], cost[seq] = 0, attention_cost(full)
            start += full
        if start < size:
            left.append((size - start, doc, start))
    left.sort(key=lambda x: (-x[0], x[1]))
    for size, doc, start in left:
        while size:
            fits = room >= size
            # Never empty: the sizes add up to the room.
            open_ = fits if fits.any() else room > 0
            seq = int(np.argmin(np.where(open_, cost, np.inf)))
            n = min(size, int(room[seq]))
            out.append((doc, start, n, seq, int(capacities[seq] - room[seq])))
            room[seq] -= n
            cost[seq] += attention_cost(n)
            size, start = size - n, start + n
    return out


def powers(total: int, most: int) -> np.ndarray:
    """``total`` as sequences of ``most`` and one of each power of two the rest is made of."""
    rest = total % most
    return np.array(
        [most] * (total // most) + [1 << b for b in range(rest.bit_length())[::-1] if rest >> b & 1],
        np.int64,
    )


def _library(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class PlainWords:
    """Ids of chunks that are a word of plain letters, with or without one mark behind it.

    The vocabulary's model is asked directly, once per word; the library's whole way through
    normaliser and splitter costs several times as much. ``usable`` tells, by comparing both
    ways on samples, whether a vocabulary is of the kind ``plain_word`` is for.
    """

    def __init__(self, library) -> None:
        self.library, self.model = library, library.model
        self.marks = {m: self._whole(m) for m in MARKS}
        self.known: dict[str, list[int]] = {}
        self.usable = all(self.ids(s) in (None, self._whole(s)) for s in PLAIN_SAMPLES)

    def _whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def ids(self, chunk: str) -> list[int] | None:
        """Ids of a chunk of that kind, None for another."""
        plain = plain_word(chunk)
        if plain is None:
            return None
        word, mark = plain
        own = self.known.get(word)
        if own is None:
            own = self.known[word] = [t.id for t in self.model.tokenize(byte_letters(word))]
        return own + self.marks[mark] if mark else own


class TokenTable:
    """Ids of chunks, worked out once per chunk for as long as the table holds it."""

    def __init__(self, path: str) -> None:
        self.library = _library(path)
        self.plain = PlainWords(self.library)
        self.table = ChunkTable(self._new, limit=KEPT_CHUNKS)

    def _new(self):
        self.plain.known.clear()
        self.ids, self.first, self.size = Growing(np.int32), Growing(np.int64), Growing(np.int64)
        return self._learn

    def _learn(self, fresh: list[str]) -> None:
        held = [self.plain.ids(c) for c in fresh] if self.plain.usable else [None] * len(fresh)
        odd = [i for i, ids in enumerate(held) if ids is None]
        whole = self.library.encode_batch([fresh[i] for i in odd], add_special_tokens=False)
        for i, e in zip(odd, whole):
            held[i] = e.ids
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        self.first.add(self.ids.n + np.cumsum(sizes) - sizes)
        self.size.add(sizes)
        self.ids.add(np.fromiter(chain.from_iterable(held), np.int32, int(sizes.sum())))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        codes, counts = self.table.encode(texts)
        sizes = self.size.view()[codes]
        flat = self.ids.view()[spread_index(self.first.view()[codes], sizes)]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        ends = np.cumsum(counts)
        return [flat[a:b] for a, b in zip(upto[ends - counts], upto[ends])]


def pack(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text: str = "text",
    capacity: int = 4096,
    end_id: int = 2,
    group_tokens: int = GROUP_TOKENS,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset`` and, if asked for, ``ids``.

    A document is its token ids and one end id; null counts as empty, so every row has a
    token. A task packs its rows in groups of about ``group_tokens`` tokens, in the order
    it reads them, and moves none to another task: sequences are filled to the last token
    inside the task, and what is left over at its end makes sequences of one power of two
    each. ``capacity`` is a power of two. ``sequence_id`` holds the partition in its high
    half. A text longer than a group is a group by itself. Rows that repeat an id are
    packed one by one, other columns are ignored, an empty table gives an empty table.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    fields = [T.StructField("id", read.schema["id"].dataType)]
    fields += [
        T.StructField(c, T.LongType())
        for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    names = [f.name for f in fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = per_worker(("ids", path), lambda: TokenTable(path))
        waiting: list[tuple[object, int, int, np.ndarray]] = []  # id, start, all tokens, ids
        base = TaskContext.get().partitionId() << 32
        held = 0

        def flush(last: bool) -> pd.DataFrame:
            nonlocal waiting, held, base
            total = held if last else held - held % capacity
            group, rest, n = [], [], 0
            for name, start, size, ids in waiting:
                take = min(len(ids), total - n)
                if take:
                    group.append((name, start, size, ids[:take]))
                if take < len(ids):
                    rest.append((name, start + take, size, ids[take:]))
                n += take
            room = powers(total, capacity)
            rows = []
            for doc, a, length, seq, offset in pack_group(
                np.array([len(g[3]) for g in group], np.int64), room
            ):
                name, start, size, ids = group[doc]
                own = ids[a : a + length]
                crc = zlib.crc32(own.astype("<u4").tobytes())
                row = (name, start + a, length, crc, size, base + seq, offset)
                rows.append((*row, own) if with_ids else row)
            base += len(room)
            waiting, held = rest, held - total
            return pd.DataFrame(rows, columns=names)

        for batch in batches:
            keys, texts = batch["id"].astype(object).tolist(), batch["text"].tolist()
            for a, b in text_slices(texts):
                for name, ids in zip(keys[a:b], table.encode(texts[a:b])):
                    ids = np.append(ids, np.int32(end_id))
                    waiting.append((None if pd.isna(name) else name, 0, len(ids), ids))
                    held += len(ids)
                if held >= group_tokens:
                    yield flush(False)
        if held:
            yield flush(True)

    return read.mapInPandas(run, T.StructType(fields)).withColumnRenamed("id", id_col)
