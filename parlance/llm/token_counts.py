"""Token counts by byte-pair merging on a heap and a linked list."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import Growing, per_worker
from parlance.llm.words import KEPT_CHUNKS, MARKS, PLAIN_SAMPLES, ChunkTable, byte_letters, plain_word, sums, text_slices


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after merging: the number at first minus the number of merges.

    The adjacent pair of lowest rank is merged next, of equal ranks the leftmost. The
    symbols form a linked list; the heap holds candidate pairs, and one whose sides have
    changed since is passed over.
    """
    n = len(symbols)
    if n < 2:
        return n
    syms: list[str | None] = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get((syms[i], syms[i + 1]))
        if rank is not None:
            heap.append((rank, i, syms[i], syms[i + 1]))
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if syms[i] != a or j >= n or syms[j] != b:
            continue
        syms[i], syms[j] = a + b, None
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = ranks.get((syms[i], syms[k]))
            if rank is not None:
                heapq.heappush(heap, (rank, i, syms[i], syms[k]))
        h = before[i]
        if h >= 0:
            rank = ranks.get((syms[h], syms[i]))
            if rank is not None:
                heapq.heappush(heap, (rank, h, syms[h], syms[i]))
    return n - merges


class PairCounter:
    """Counts of one vocabulary file; its own rules split and normalise the text.

    Words of plain letters need neither, if samples show that the file's rules leave them
    whole. Counts of words and chunks are kept until their table reaches its limit.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        rules = Tokenizer.from_file(path)
        self.normal, self.pre = rules.normalizer, rules.pre_tokenizer
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.ranks = {
            tuple(m.split(" ") if isinstance(m, str) else m): r
            for r, m in enumerate(spec["model"]["merges"])
        }
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.known: dict[str, int] = {}
        self.marks = {m: self.count(m) for m in MARKS}
        self.plain = True
        self.plain = all(self.chunk(s) == self.count(s) for s in PLAIN_SAMPLES)
        self.table = ChunkTable(self._new, limit=KEPT_CHUNKS)

    def _new(self):
        self.known.clear()
        self.counts = Growing(np.int64)
        return self._learn

    def _learn(self, fresh: list[str]) -> None:
        self.counts.add(np.fromiter(map(self.chunk, fresh), np.int64, len(fresh)))

    def chunk(self, chunk: str) -> int:
        """Tokens of a run of text without white space."""
        plain = plain_word(chunk) if self.plain else None
        if plain is None:
            return self.count(chunk)
        word, mark = plain
        return self.word(byte_letters(word)) + (self.marks[mark] if mark else 0)

    def counts_of(self, texts: list[str]) -> np.ndarray:
        codes, sizes = self.table.encode(texts)
        return sums(self.counts.view()[codes], sizes)

    def word(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            symbols = list(word)
            symbols[-1] += self.suffix
            n = self.known[word] = merged_length(symbols, self.ranks)
        return n

    def count(self, text: str) -> int:
        """Tokens of a text; a special string counts one, as the library has it by default."""
        if self.special is None:
            parts, held = [text], 0
        else:
            split = self.special.split(text)
            parts, held = split[::2], len(split) // 2
        for part in parts:
            if part:
                normal = self.normal.normalize_str(part) if self.normal else part
                held += sum(self.word(w) for w, _ in self.pre.pre_tokenize_str(normal) if w)
        return held


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The rows with ``n_bytes`` (UTF-8) and ``n_tokens`` in place of the text column.

    ``path`` names a vocabulary file every worker has. Each text is read whole, in the
    task that holds its row; null counts as empty and has no bytes and no tokens. Rows
    that repeat are counted one by one, other columns pass through, columns named like
    the new ones are replaced, an empty table gives an empty table.
    """
    given = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens")]
    body = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(
        *given, F.octet_length(body).cast("long").alias("n_bytes"), body.alias("n_tokens")
    )
    schema = T.StructType([
        *read.schema.fields[:-1], T.StructField("n_tokens", T.LongType())
    ])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = per_worker(("pairs", path), lambda: PairCounter(path))
        for batch in batches:
            texts = batch["n_tokens"].tolist()
            counts = np.zeros(len(texts), np.int64)
            for a, b in text_slices(texts):
                counts[a:b] = counter.counts_of(texts[a:b])
            yield batch.assign(n_tokens=counts)

    return read.mapInPandas(run, schema)
