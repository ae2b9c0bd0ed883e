"""Licence notices and licence identifier tags in texts.

Two Aho-Corasick automata read every text once each: one finds notice phrases among its
words, one finds the tags that announce a licence expression. An expression is read by a
shunting-yard parser that works out how restrictive it is while it reads: ``or`` leaves the
choice and takes the freer side, ``and`` binds to both and takes the stricter one, ``with``
eases a copyleft licence by its exception.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases that are counted, with their labels.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
# Further phrases that add a label.
NOTICES = [
    ("gnu lesser general public license", "lgpl"),
    ("gnu library general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("bsd license", "bsd"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("permission is hereby granted free of charge", "mit"),
    ("creative commons attribution", "cc-by"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("cc by nc", "cc-by-nc"),
    ("cc by nc sa", "cc-by-nc-sa"),
    ("cc by nc nd", "cc-by-nc-nd"),
    ("cc0", "cc0"),
    ("dedicated to the public domain", "public-domain"),
    ("all rights reserved", "proprietary"),
]
# What announces an expression; the rest of its line is read.
TAGS = ["spdx-license-identifier:", "license-expression:", "licence-expression:"]
# How far a licence binds those who use the text: 0 not at all, 1 no use without leave.
RESTRICTION = {
    "public-domain": 0.1, "cc0": 0.1, "unlicense": 0.1, "0bsd": 0.1,
    "mit": 0.2, "bsd": 0.2, "isc": 0.2, "zlib": 0.2, "apache": 0.2,
    "cc-by": 0.3,
    "lgpl": 0.6, "mpl": 0.6, "epl": 0.6, "cc-by-sa": 0.6,
    "gpl": 0.8,
    "agpl": 0.9, "cc-by-nd": 0.9, "cc-by-nc": 0.9, "cc-by-nc-sa": 0.9, "cc-by-nc-nd": 0.9,
    "proprietary": 1.0,
}
UNKNOWN, EASED = 0.5, 0.6

LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# Bytes of words as they are, A-Z lower-cased, every other ASCII byte a blank.
WORD_BYTES = bytes(
    b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32
    for b in range(256)
)
TOKEN = re.compile(r"\s*(?:([()])|([0-9a-z][0-9a-z.:+-]*))")
BINDS = {"or": 1, "and": 2, "with": 3}

NOTICE = pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int32())])
TAG = pa.struct([("expression", pa.string()), ("at", pa.int64()), ("restriction", pa.float64())])
# Columns of a result: name, type in Spark, type in Arrow.
FIELDS = [
    ("n_words", "bigint", pa.int64()),
    ("n_base", "bigint", pa.int64()),
    ("first_word", "bigint", pa.int64()),
    ("last_word", "bigint", pa.int64()),
    ("base_labels", "string", pa.string()),
    ("labels", "string", pa.string()),
    ("score", "double", pa.float64()),
    ("notices", "array<struct<label: string, word: bigint, words: int>>", pa.list_(NOTICE)),
    ("tags", "array<struct<expression: string, at: bigint, restriction: double>>", pa.list_(TAG)),
]


def family(name: str, known: dict[str, float] = RESTRICTION) -> str:
    """Label of a licence identifier: the longest known name it is or goes on from by a dash."""
    name = name.rstrip("+")
    head = name
    while head not in known and "-" in head:
        head = head.rpartition("-")[0]
    return head if head in known else name


def read_expression(
    line: str, known: dict[str, float] = RESTRICTION
) -> tuple[str, list[str], float] | None:
    """Reads the licence expression a line starts with.

    Gives its tokens joined by blanks, the labels of its licences, and its restriction. The
    expression ends at the first token that can't go on with it. None where no complete
    expression stands: nothing to read, an operator without its right side, an open bracket.
    """
    values: list[float] = []
    waiting: list[str] = []
    labels: list[str] = []
    read: list[str] = []
    at, depth, operand = 0, 0, True

    def settle_top() -> None:
        op, right, left = waiting.pop(), values.pop(), values.pop()
        if op == "or":
            values.append(min(left, right))
        elif op == "and":
            values.append(max(left, right))
        else:
            values.append(min(left, EASED))

    while m := TOKEN.match(line, at):
        bracket, name = m.groups()
        if operand:
            if bracket == ")" or name in BINDS:
                break
            if bracket:
                if waiting and waiting[-1] == "with":
                    break
                waiting.append("(")
                depth += 1
            else:
                if not (waiting and waiting[-1] == "with"):
                    labels.append(family(name, known))
                    values.append(known.get(labels[-1], UNKNOWN))
                else:
                    values.append(0.0)
                operand = False
        elif bracket == ")":
            if not depth:
                break
            while waiting[-1] != "(":
                settle_top()
            waiting.pop()
            depth -= 1
        elif name in BINDS:
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[name]:
                settle_top()
            waiting.append(name)
            operand = True
        else:
            break
        read.append(bracket or name)
        at = m.end()
    if operand or depth:
        return None
    while waiting:
        settle_top()
    return " ".join(read), labels, values[0]


def automaton(entries: list[tuple[str, object]]) -> ahocorasick.Automaton:
    """Automaton of the given strings; a string given twice carries both values."""
    carried: dict[str, list] = {}
    for key, value in entries:
        carried.setdefault(key, []).append(value)
    built = ahocorasick.Automaton()
    for key, values in carried.items():
        built.add_word(key, (len(key), values))
    if carried:
        built.make_automaton()
    return built


class Scanner:
    """The automata of one set of phrases and tags, read over one text at a time."""

    def __init__(self, base, notices, tags, known) -> None:
        plain = lambda phrase: phrase.lower().encode().translate(WORD_BYTES).split()
        entries = [
            (b" ".join([b"", *plain(phrase), b""]).decode("latin-1"), (label, len(plain(phrase)), own))
            for own, phrases in ((True, base), (False, notices))
            for phrase, label in phrases
            if plain(phrase)
        ]
        self.phrases, self.known = automaton(entries), known
        self.tags = automaton([(t.lower().encode().decode("latin-1"), None) for t in tags])

    def notices(self, words: list[bytes]) -> Iterator[tuple[str, int, int, bool]]:
        """Label, first word, number of words, and whether the phrase is a base one."""
        if not len(self.phrases):
            return
        body = b" ".join([b"", *words, b""]).decode("latin-1")
        seen, word = 0, 0
        for end, (length, values) in self.phrases.iter(body):
            start = end - length + 1
            if start >= seen:
                word += body.count(" ", seen, start)
            else:
                word -= body.count(" ", start, seen)
            seen = start
            for label, n, own in values:
                yield label, word, n, own

    def expressions(self, text: bytes) -> Iterator[tuple[str, int, list[str], float]]:
        """Expression, byte where its tag starts, labels and restriction."""
        if not len(self.tags):
            return
        body = text.translate(LOWER_ASCII).decode("latin-1")
        for end, (length, _) in self.tags.iter(body):
            stop = body.find("\n", end)
            got = read_expression(body[end + 1 : stop if stop >= 0 else None], self.known)
            if got:
                yield got[0], end - length + 1, got[1], got[2]

    def scan(self, text: bytes) -> tuple:
        words = text.translate(WORD_BYTES).split()
        found = list(self.notices(words))
        tags = list(self.expressions(text))
        starts = [word for _, word, _, own in found if own]
        base = {label for label, _, _, own in found if own}
        noticed = {label for label, *_ in found}
        named = {label for _, _, labels, _ in tags for label in labels}
        binding = [self.known.get(label, UNKNOWN) for label in noticed] + [t[3] for t in tags]
        return (
            len(words), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(noticed | named)), max(binding, default=0.0),
            [{"label": a, "word": b, "words": c} for a, b, c, _ in found],
            [{"expression": a, "at": b, "restriction": d} for a, b, _, d in tags],
        )


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    base: list[tuple[str, str]] = BASE,
    notices: list[tuple[str, str]] = NOTICES,
    tags: list[str] = TAGS,
    known: dict[str, float] = RESTRICTION,
) -> DataFrame:
    """One row per input row: its id and what licences its text names.

    Words are maximal runs of digits, letters a-z (A-Z lower-cased) and characters beyond
    ASCII. A phrase is found where its words stand next to one another, whatever stands
    between them; overlapping places all count. ``n_base``, ``first_word``, ``last_word`` and
    ``base_labels`` are of the ``base`` phrases alone: number of places, smallest and largest
    first word (from 0; null without one), labels sorted and joined by commas. ``labels`` adds
    those of ``notices`` and of the licences in tagged expressions. ``score`` is the largest
    restriction of a noticed label or a tagged expression, 0 where nothing is found. ``notices`` lists all
    places of phrases, ``tags`` all readable expressions with the byte their tag starts at.

    Each text is read whole and alone, in the task that scans it: no shuffle, and one text
    with its words is the most a task holds. A null or empty text has no words and no labels.
    Null and repeated ids pass through row by row; rows with equal texts get equal results.
    Extra columns are ignored, an empty table gives an empty table. A tag whose line holds no
    complete expression is passed over.
    """
    rows = docs.select(F.col(id_col), F.coalesce(text, F.lit("")).cast("binary").alias("body"))
    names, kinds, types = zip(*FIELDS)
    own = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join(f"`{n}` {k}" for n, k in [(id_col, own), *zip(names, kinds)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices, tags, known)
        for batch in batches:
            body = batch.column(1)
            made = list(zip(*(scanner.scan(body[i].as_py()) for i in range(len(body)))))
            arrays = [pa.array(c, t) for c, t in zip(made or [()] * len(names), types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [id_col, *names])

    return rows.mapInArrow(scan, schema)
