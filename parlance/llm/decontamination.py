"""Benchmark passages in documents, found by windows of templates.

A text becomes a sequence of words in which numbers, names and units are typed
placeholders. Windows of that sequence are joined by hash with those of the benchmark, and
a match counts if the values under the placeholders map one to one, so a question with
other numbers or names is found as well. Windows of which half or more are placeholders say
too little for that. All windows are also joined as they are written, which finds copies in
other letter case or with other line ends, and once more with every run of capitalised words
as one name, wherever the sentence begins.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import (
    ROW, Growing, keeps_columns, mix64, numbered, spread_index, window_hash,
)
from parlance.llm.words import ChunkTable, chunks_of, sums, text_slices

WIDTH = 13
# Items of fewer words are matched whole and as written; of fewer than LEAST, only by a
# document that is nothing else.
SHORT, LEAST = 8, 3
# Copies of each benchmark window, over which the matches of a frequent passage are dealt.
SALTS = 16
# Size of the filter in front of the join: 2^20 words of 64 bits, 8 MB whatever the input.
FILTER_WORDS = 1 << 20
UNITS = frozenset(
    "mm cm m km inch inches ft feet foot yard yards mile miles mg g kg gram grams kilogram "
    "kilograms ton tons tonnes lb lbs pound pounds oz ml l liter liters litre litres ms s sec "
    "second seconds min minute minutes h hr hour hours day days week weeks month months year "
    "years percent dollar dollars euro euros cent cents usd eur mph kmh hz khz mhz ghz kb mb gb "
    "tb v w kw kwh degrees degree celsius fahrenheit meter meters metre metres kilometer "
    "kilometers kilometre kilometres".split()
)
# Letters of scripts that put no blanks between words; each is a word here.
UNSPACED = (
    "\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
    "\U00020000-\U0003ffff"
)
TOKEN = re.compile(rf"[0-9]+(?:[.,][0-9]+)*|(?=[^\W\d_])(?:[{UNSPACED}]|[^\W\d_{UNSPACED}]+)")
SENTENCE_END = re.compile(r"[.!?:;][\"')\]]*$")
PLAIN, NUMBER, UNIT, NAME = 0, 1, 2, 3
# Places of the ways of reading in what ``readings`` gives.
TEMPLATE, WRITTEN, NAMES = 0, 1, 2
MARKS = np.array([0, 0x1F3D5B79, 0x2E4C6A88, 0x3D5B7997], np.uint64)
K2 = np.uint64(0xC2B2AE3D27D4EB4F)


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


def _learner():
    """Tokens of new chunks: hash, kind, capital; per chunk how many and if it ends a sentence."""
    hashes, kinds, capital = Growing(np.uint64), Growing(np.int8), Growing(bool)
    first, size, ends = Growing(np.int64), Growing(np.int64), Growing(bool)

    def learn(fresh: list[str]) -> None:
        h, k, c, n = [], [], [], []
        for chunk in fresh:
            found = TOKEN.findall(chunk)
            n.append(len(found))
            for t in found:
                low = t.lower()
                h.append(word_hash(low))
                k.append(NUMBER if t[0].isdigit() else UNIT if low in UNITS else PLAIN)
                c.append(len(t) > 1 and t[0].isupper() and t[1:].islower())
        sizes = np.array(n, np.int64)
        first.add(hashes.n + np.cumsum(sizes) - sizes)
        size.add(sizes)
        ends.add(np.array([bool(SENTENCE_END.search(x)) for x in fresh], bool))
        hashes.add(np.array(h, np.uint64))
        kinds.add(np.array(k, np.int8))
        capital.add(np.array(c, bool))

    learn.parts = (hashes, kinds, capital, first, size, ends)
    return learn


def _split(text: str) -> list[str]:
    # A line end also ends a sentence.
    return chunks_of(text.replace("\n", " . "))


def template_table() -> ChunkTable:
    return ChunkTable(_learner, _split)


def templates(table: ChunkTable, texts: list[str]) -> tuple[np.ndarray, ...]:
    """Words and placeholders of all texts in a row, kinds, values, which are capitalised,
    and counts per text."""
    codes, chunks = table.encode(texts)
    hashes, kinds, capital, first, size, ends = (p.view() for p in table.learn.parts)
    sizes = size[codes]
    at = spread_index(first[codes], sizes)
    value, kind, upper = hashes[at], kinds[at].copy(), capital[at]
    counts = sums(sizes, chunks)

    opens = np.ones(len(codes), bool)
    opens[1:] = ends[codes[:-1]]
    opens[(np.cumsum(chunks) - chunks)[chunks > 0]] = True
    begins = np.zeros(len(at), bool)
    held = sizes > 0
    begins[(np.cumsum(sizes) - sizes)[held]] = opens[held]

    heads = (np.cumsum(counts) - counts)[counts > 0]
    after_number = np.zeros(len(at), bool)
    after_number[1:] = kind[:-1] == NUMBER
    after_number[heads] = False
    kind[(kind == UNIT) & ~after_number] = PLAIN
    kind[(kind == PLAIN) & upper & ~begins] = NAME
    return np.where(kind == PLAIN, value, MARKS[kind]), kind, value, upper, counts


def _one_name(
    kind: np.ndarray, value: np.ndarray, upper: np.ndarray, counts: np.ndarray, place: np.ndarray
) -> tuple[np.ndarray, ...]:
    """The texts with each run of capitalised words as one name, sentence openers included."""
    kind = np.where((kind == PLAIN) & upper, NAME, kind)
    more = kind == NAME
    more[1:] &= kind[:-1] == NAME
    more &= place > 0
    at = np.flatnonzero(~more)
    size = np.diff(np.append(at, len(kind)))
    held = value[at]
    long = np.flatnonzero(size > 1)
    if len(long):
        n = size[long]
        words = spread_index(at[long], n)
        nth = spread_index(np.zeros(len(n), np.int64), n).astype(np.uint64)
        held[long] = mix64(np.add.reduceat(mix64(value[words] + nth * K2), np.cumsum(n) - n))
    kind = kind[at]
    seq = np.where(kind == PLAIN, held, MARKS[kind])
    return seq, kind, held, counts - sums(more, counts), place[at]


def readings(table: ChunkTable, texts: list[str]) -> list[tuple[np.ndarray, ...]]:
    """The ways all texts are read: sequence, kinds, values, counts, and each word's place.

    First with placeholders, then as written, without any, then with runs of capitalised
    words as one name. A place is that of a word in the text, also where a run stands for it.
    """
    seq, kind, value, upper, counts = templates(table, texts)
    place = spread_index(np.zeros(len(counts), np.int64), counts)
    return [
        (seq, kind, value, counts, place),
        (value, np.zeros_like(kind), value, counts, place),
        _one_name(kind, value, upper, counts, place),
    ]


def second_hash(seq: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    out = np.full(len(at), 0x5851F42D4C957F2D, np.uint64)
    for j in range(width):
        out = mix64(out * K2 + seq[at + j])
    return out


def item_width(n: int, width: int = WIDTH) -> int:
    """Window of an item of ``n`` words; one word short, so that either end may differ."""
    return width if n > width else n - 1 if n > SHORT else n


def heavy_windows(kind: np.ndarray, width: int) -> np.ndarray:
    """Whether half or more of a window are placeholders, for each place it may start at."""
    filled = np.concatenate(([0], np.cumsum(kind != PLAIN)))
    return 2 * (filled[width:] - filled[: len(kind) - width + 1]) >= width


WINDOW = "key long, `check` long, slots array<long>"


def _rows(keys, at, width, seq, kind, value):
    """Key, check and slot values of the windows that start at ``at``."""
    check = second_hash(seq, at, width).view(np.int64)
    filled = np.concatenate(([0], np.cumsum(kind != PLAIN)))
    signed = value.view(np.int64)
    slots = [[]] * len(at)
    for i in np.flatnonzero(filled[at + width] - filled[at]):
        part = slice(at[i], at[i] + width)
        slots[i] = signed[part][kind[part] != PLAIN].tolist()
    return keys.view(np.int64), check, slots


def benchmark_windows(items: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """All windows of all items as written, those with more words than placeholders also so."""
    read = items.select(F.col(item_id).alias("item"), F.coalesce(text, F.lit("")).alias("text"))
    schema = T.StructType([
        read.schema["item"], *T.StructType.fromDDL("way int, width int, whole boolean, at int").fields,
        *T.StructType.fromDDL(WINDOW).fields,
    ])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = template_table()
        for batch in batches:
            for item, text in zip(batch["item"], batch["text"]):
                for way, (seq, kind, value, counts, place) in enumerate(readings(table, [text])):
                    n = int(counts[0])
                    w = item_width(n, width)
                    if not w:
                        continue
                    # A short item has too few words for placeholders: in a text they would
                    # fit too much.
                    whole = n < LEAST or n < SHORT and way != WRITTEN
                    # As written there are no placeholders, so nothing is left out.
                    at = np.flatnonzero(~heavy_windows(kind, w))
                    if not len(at):
                        continue
                    keys = window_hash(seq, w)
                    key, check, slots = _rows(keys[at], at, w, seq, kind, value)
                    yield pd.DataFrame({
                        "item": [item] * len(at), "way": np.int32(way), "width": np.int32(w),
                        "whole": whole, "at": place[at].astype(np.int32),
                        "key": key, "check": check, "slots": slots,
                    })

    return read.mapInPandas(run, schema)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
) -> DataFrame:
    """One row per document and item it holds: row number, id, item, ``n_windows``, ``exact``.

    A document holds an item if a window of ``width`` words of the item's template occurs
    in its own and the values of the placeholders map one to one; ``exact`` says that in
    some window they are the same. Items of over ``SHORT`` up to ``width`` words are matched
    by all but one of their words, shorter ones by all of them as they are written, wherever
    they stand; one or two words, and the template of a short item, only by a document that is
    nothing else.

    Words are letters in any case; in scripts without blanks each letter is a word. Numbers
    become one placeholder, so do units after a number and capitalised words inside a
    sentence; a window of which half or more are placeholders is matched by the same words,
    numbers and names only. Texts are read in two more ways: as written, without
    placeholders, so letter case and line ends do not matter, and with each run of
    capitalised words as one name, those that open a sentence included. ``n_windows`` counts
    the places of the item at which a window found begins.

    Texts are read whole, however long. Null and empty texts hold nothing, an item without
    words is held by nothing, repeated documents and items are reported each for itself.
    Extra columns are ignored. An empty table gives an empty table.

    The benchmark's window hashes set bits in a filter of fixed size, which the tasks that
    read documents ask first; what passes is joined with the windows by hash, whatever
    their number.
    """
    return _leaks(numbered(docs.select(*dict.fromkeys([id_col, text]))), benchmark, id_col, text,
                  item_id, item_text, width)


def _leaks(
    rows: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", width: int = WIDTH,
) -> DataFrame:
    """``find_leaks`` of ``numbered`` rows."""
    windows = benchmark_windows(benchmark, item_id, item_text, width)
    hashed = windows.select(
        F.shiftrightunsigned("key", 44).alias("word"),
        F.expr("shiftleft(1L, cast(shiftrightunsigned(key, 38) % 64 as int))").alias("bit"),
    )
    # One filter for all widths and ways: FILTER_WORDS rows at most.
    bits = hashed.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    ways = windows.select("way", "width", "whole").distinct().collect()
    asked = sorted((r["way"], r["width"], r["whole"]) for r in ways)
    seen = np.zeros(FILTER_WORDS, np.uint64)
    seen[bits["word"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64).view(np.uint64)
    held = rows.sparkSession.sparkContext.broadcast(seen)

    read = rows.select(ROW, F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    # Ids travel as they are, looked up by row only where a window passed.
    schema = T.StructType([
        read.schema[ROW], read.schema["id"], *T.StructType.fromDDL(WINDOW).fields
    ])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, filter_ = template_table(), held.value
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in text_slices(texts):
                read_as = readings(table, texts[a:b])
                for way, w, whole in asked:
                    seq, kind, value, counts, place = read_as[way]
                    ends = np.cumsum(counts)
                    rest = np.repeat(counts, counts) - place
                    keys = window_hash(seq, w)
                    hit = filter_[(keys >> np.uint64(44)).astype(np.int64)]
                    hit = hit >> ((keys >> np.uint64(38)) & np.uint64(63)) & np.uint64(1)
                    at = np.flatnonzero((hit == 1) & (rest[: len(keys)] >= w))
                    doc = np.searchsorted(ends, at, "right")
                    if whole:
                        at, doc = at[counts[doc] == w], doc[counts[doc] == w]
                    if len(at):
                        key, check, slots = _rows(keys[at], at, w, seq, kind, value)
                        own = batch.iloc[a + doc][[ROW, "id"]].reset_index(drop=True)
                        yield own.assign(key=key, check=check, slots=slots)

    found = read.mapInPandas(run, schema).distinct()
    offered = windows.select(
        "item", "at", "key", "check", F.col("slots").alias("given"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    ).distinct()
    met = found.withColumn("salt", F.pmod(F.hash(ROW), F.lit(SALTS))).join(
        offered, ["key", "check", "salt"]
    )
    pairs = F.size(F.array_distinct(F.arrays_zip("slots", "given")))
    apart = [F.size(F.array_distinct(c)) for c in ("slots", "given")]
    one_to_one = (pairs == apart[0]) & (pairs == apart[1])
    return (
        met.filter(one_to_one)
        .groupBy(ROW, "id", "item")
        .agg(
            F.count_distinct("at").alias("n_windows"),
            F.max(F.expr("slots = given")).alias("exact"),
        )
    )


@keeps_columns
def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no item, columns as given.

    Null and empty texts stay, repeated rows stay or go together, an empty table or benchmark
    changes nothing.
    """
    rows = numbered(docs)
    leaks = _leaks(rows, benchmark, **options).select(ROW).distinct()
    return rows.join(leaks, ROW, "left_anti").select(*docs.columns)
