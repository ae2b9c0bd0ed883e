"""Texts cut at white space into chunks whose properties are worked out once per worker.

A tokenizer's normaliser and splitting rule never join text across white space, so what a
chunk becomes does not depend on its neighbours. The table of chunks is emptied when it
reaches its limit, which bounds memory and changes no result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np

from parlance.llm.common import Codes

# White space of Unicode. str.split() also cuts at the four separators below it.
BLANK = re.compile("[\t-\r \x85\xa0  -     　]+")
ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
CHUNK_LIMIT = 300_000
# Where little is kept per chunk and the table outlives a task.
KEPT_CHUNKS = 700_000
SLICE_CHARS = 1 << 20


def chunks_of(text: str) -> list[str]:
    """Maximal runs without Unicode white space."""
    if any(c in text for c in ODD):
        return [c for c in BLANK.split(text) if c]
    return text.split()


# Marks a word may have behind it, and a bound on its letters: below it the lower case of a
# letter is one letter whatever is around it.
MARKS, LETTERS_BELOW = ".,;:!?", "\u0130"


def plain_word(chunk: str) -> tuple[str, str] | None:
    """Lower-cased word and mark of a chunk that is plain letters, with or without a mark.

    For a vocabulary that lower-cases, splits letters from marks and works on bytes such a
    word is one unit, so it need not go through normaliser and splitter.
    """
    mark = chunk[-1] if chunk[-1] in MARKS else ""
    word = chunk[:-1] if mark else chunk
    if not word.isalpha() or not word.isascii() and (
        max(word) >= LETTERS_BELOW or not unicodedata.is_normalized("NFC", word)
    ):
        return None
    return word.lower(), mark


def _byte_letters() -> dict[int, int]:
    """Bytes to the letters byte-level vocabularies write them as: printable ones as they
    are, the others, in order, from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: b for b in plain}, **{b: 256 + i for i, b in enumerate(rest)}}


BYTE_LETTERS = _byte_letters()


def byte_letters(word: str) -> str:
    """A word as a byte-level vocabulary spells it."""
    return word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)


# Chunks a rule for plain words is tried on before it is trusted.
PLAIN_SAMPLES = ["word", "Word,", "éÀß.", "ab", "Thenon!", "aº;", "xÿ", "don?", "ZZ:"]


def text_slices(texts: list, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters; one longer text is a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


class ChunkTable:
    """Codes of chunks; ``learn`` is given new chunks in the order of their codes."""

    def __init__(
        self,
        new: Callable[[], Callable[[list], None]],
        split: Callable[[str], list] = chunks_of,
        limit: int = CHUNK_LIMIT,
    ) -> None:
        self.new, self.split, self.limit = new, split, limit
        self.reset()

    def reset(self) -> None:
        self.codes, self.learn = Codes(), self.new()

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all chunks of all texts, and the number of chunks of each text."""
        if len(self.codes) > self.limit:
            self.reset()
        words: list = []
        counts = np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            own = self.split(t)
            counts[i] = len(own)
            words += own
        codes = self.codes.encode(words)
        fresh = self.codes.take()
        if fresh:
            try:
                self.learn(fresh)
            except BaseException:
                # A table that outlives this task must not hold chunks it knows nothing of.
                self.reset()
                raise
        return codes, counts


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of ``counts`` values."""
    upto = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(counts)
    return upto[ends] - upto[ends - counts]
