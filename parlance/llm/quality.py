"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. What it looks like, what its neighbours look like and which
label they have decide; forward and backward sums give the probability that it is good,
and the lines' probabilities, weighted by length, make the document's score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from parlance.llm.common import Growing
from parlance.llm.labelled import Sample, calibrate, score_texts, sigmoid
from parlance.llm.words import ChunkTable, sums

SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\-]")
CLASSES = 8  # characters, capitals, digits, symbols, stops, shouts, no letters, all capitals
LINE_FEATURES = 13
SATURATE = (1.0, 4.0)


def _chunk_counts(chunk: str) -> list[int]:
    capitals = sum(map(str.isupper, chunk))
    letters = sum(map(str.isalpha, chunk))
    return [
        len(chunk), capitals, sum(map(str.isdigit, chunk)), len(SYMBOL.findall(chunk)),
        chunk[-1] in ".?;:", "!" in chunk, not letters, letters > 1 and capitals == letters,
    ]


def lines_of(text: str) -> list[str]:
    """Lines between line feeds; an empty text has one empty line."""
    return text.split("\n")


class Reader:
    """Features of all lines of all texts; what a chunk looks like is worked out once."""

    def __init__(self) -> None:
        self.table = ChunkTable(self._new)

    def _new(self):
        self.looks = Growing(np.float32, CLASSES)
        return self._learn

    def _learn(self, fresh: list[str]) -> None:
        self.looks.add(np.array([_chunk_counts(c) for c in fresh], np.float32))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features (lines, F), line lengths, and lines per text."""
        split = [lines_of(t) for t in texts]
        lines = [line for own in split for line in own]
        per_text = np.fromiter(map(len, split), np.int64, len(split))
        codes, words = self.table.encode(lines)
        counts = np.stack([sums(c, words) for c in self.looks.view()[codes].T.astype(np.float64)], 1)
        n, chars = np.maximum(words, 1), np.maximum(counts[:, 0], 1)
        owner = np.repeat(np.arange(len(lines)), words)
        again = np.zeros(len(codes), bool)
        again[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
        pair = np.sort(owner * (len(self.table.codes) + 1) + codes)
        new = np.ones(len(pair), bool)
        new[1:] = pair[1:] != pair[:-1]
        span = len(self.table.codes) + 1
        distinct = np.bincount(pair[new] // span, minlength=len(lines))
        size = np.fromiter(map(len, lines), np.int64, len(lines))
        shares = np.stack([
            counts[:, 1] / chars, counts[:, 2] / chars, counts[:, 3] / chars, counts[:, 4] / n,
            counts[:, 5] / n, counts[:, 6] / n, counts[:, 7] / n, sums(again, words) / n,
            np.where(words > 3, 1 - distinct / n, 0),
        ], 1)
        same = np.zeros(len(lines), bool)
        same[1:] = [a == b and a != "" for a, b in zip(lines, lines[1:])]
        same[np.cumsum(per_text) - per_text] = False
        plain = np.stack([
            np.log1p(size) / 6, np.minimum(chars / n, 30) / 10, words == 0, same,
        ], 1)
        own = np.concatenate([shares, plain], 1)
        return _with_neighbours(own, per_text), size + 1.0, per_text


def _with_neighbours(own: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """A line's features, squeezed two ways, next to those of the lines around it."""
    squeezed = np.concatenate([np.tanh(s * own) for s in SATURATE], 1)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    heads = np.cumsum(per_text) - per_text
    before[heads], after[heads + per_text - 1] = 0, 0
    edge = np.zeros((len(own), 2))
    edge[heads, 0], edge[heads + per_text - 1, 1] = 1, 1
    return np.concatenate([np.ones((len(own), 1)), squeezed, np.tanh(before), np.tanh(after), edge], 1)


FEATURES = 1 + 4 * LINE_FEATURES + 2


@dataclass
class Field:
    """Weight of each feature for good against bad, and the gain of equal neighbours."""

    weights: np.ndarray
    pair: np.ndarray  # (2, 2): from, to; 1 is good
    slope: float = 1.0
    offset: float = 0.0


def chains(per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts by falling number of lines, their first lines, and how many reach each step."""
    order = np.argsort(-per_text, kind="stable")
    heads = (np.cumsum(per_text) - per_text)[order]
    reach = np.searchsorted(-per_text[order], -np.arange(per_text.max(initial=0)), "left")
    return order, heads, reach


def marginals(
    emission: np.ndarray, pair: np.ndarray, per_text: np.ndarray, edges: bool = False
) -> tuple[np.ndarray, np.ndarray | None, float]:
    """Probability that each line is good, sums over line pairs, and the log normaliser.

    ``emission`` is the score of good against bad. All texts advance together, a line at
    a time; a text drops out after its last line.
    """
    _, heads, reach = chains(per_text)
    steps, n = len(reach), len(per_text)
    score = np.stack([np.zeros(len(emission)), emission], 1)
    alpha, beta = np.zeros((len(emission), 2)), np.zeros((len(emission), 2))
    log_z = 0.0
    for t in range(steps):
        at = heads[: reach[t]] + t
        a = score[at]
        if t:
            before = alpha[at - 1]
            a = a + np.logaddexp(before[:, :1] + pair[0], before[:, 1:] + pair[1])
        # Kept near 0; what is taken off goes to the normaliser.
        top = a.max(axis=1, keepdims=True)
        alpha[at] = a - top
        log_z += float(top.sum())
    total = np.zeros((2, 2)) if edges else None
    for t in range(steps - 1, -1, -1):
        at = heads[: reach[t]] + t
        if t + 1 < steps:
            on = heads[: reach[t + 1]] + t + 1
            s = (score[on] + beta[on])[:, None, :] + pair
            b = np.logaddexp(s[..., 0], s[..., 1])
            if edges:
                joint = alpha[on - 1][..., None] + s
                joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
                total += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            beta[on - 1] = b - b.max(axis=1, keepdims=True)
    both = alpha + beta
    if n:
        last = heads + np.sort(per_text)[::-1] - 1
        log_z += float(np.logaddexp(alpha[last, 0], alpha[last, 1]).sum())
    return sigmoid(both[:, 1] - both[:, 0]), total, log_z


def document_scores(good: np.ndarray, lengths: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Share of good text: line probabilities weighted by length."""
    return sums(good * lengths, per_text) / np.maximum(sums(lengths, per_text), 1)


def logit(share: np.ndarray) -> np.ndarray:
    x = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(x) - np.log1p(-x)


def train(sample: Sample, rounds: int = 3, steps: int = 80, rate: float = 0.1) -> Field:
    """Fits the field on a sample.

    Documents carry the labels: lines of good documents are good; those of bad documents
    start as bad, and the ones the field then takes for good become good in the next
    round, unless a document would have no bad line left. A sample without both labels
    leaves a field that gives every text the same score.
    """
    field = Field(np.zeros(FEATURES), np.zeros((2, 2)))
    y = sample.labels
    if len(set(y.tolist())) < 2:
        field.slope = 0.0
        field.offset = 2.0 if not len(y) or y[0] == 1 else -2.0
        return field
    x, lengths, per_text = Reader()(sample.texts)
    owner = np.repeat(np.arange(len(y)), per_text)
    line = y[owner].astype(float)
    weights = 1 / np.sqrt(per_text)[owner]
    for _ in range(rounds):
        theta = np.concatenate([field.weights, field.pair.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        inner = np.ones(len(line), bool)
        inner[np.cumsum(per_text) - per_text] = False
        pairs = np.zeros((2, 2))
        np.add.at(pairs, (line[np.flatnonzero(inner) - 1].astype(int), line[inner].astype(int)), 1)
        for tick in range(1, steps + 1):
            w, pair = theta[:FEATURES], theta[FEATURES:].reshape(2, 2)
            good, joint, _ = marginals(x @ w, pair, per_text, edges=True)
            g = np.concatenate([
                x.T @ ((good - line) * weights) / weights.sum() + 1e-4 * w,
                ((joint - pairs) / max(1, inner.sum()) + 1e-3 * pair).ravel(),
            ])
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            size = rate * np.sqrt(1 - 0.98**tick) / (1 - 0.9**tick)
            theta = theta - size * m / (np.sqrt(v) + 1e-8)
        field.weights, field.pair = theta[:FEATURES], theta[FEATURES:].reshape(2, 2)
        good, _, _ = marginals(x @ field.weights, field.pair, per_text)
        line = np.where(y[owner] == 1, 1.0, good > 0.8)
        worst = np.full(len(y), 2.0)
        np.minimum.at(worst, owner, good)
        line[(y[owner] == 0) & (good <= worst[owner])] = 0
    raw = logit(document_scores(good, lengths, per_text))
    field.slope, field.offset = calibrate(raw, y, sample.weights, float(np.average(y, weights=sample.weights)))
    return field


class Scorer:
    """Scores of texts under a trained field."""

    def __init__(self, field: Field) -> None:
        self.field, self.reader = field, Reader()

    def __call__(self, texts: list[str]) -> np.ndarray:
        x, lengths, per_text = self.reader(texts)
        good, _, _ = marginals(x @ self.field.weights, self.field.pair, per_text)
        raw = logit(document_scores(good, lengths, per_text))
        return sigmoid(self.field.slope * raw + self.field.offset)


def score_quality(
    docs: DataFrame, field: Field, text: str = "text", keep_text: bool = False
) -> DataFrame:
    """The rows with ``score`` (0 to 1, higher is better) in place of their text, or next to it.

    All lines of the whole text are labelled. Null and empty texts are one empty line and
    get the score it has. Repeated rows get the same score, other columns pass through, a
    column named ``score`` is replaced, an empty table gives an empty table.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)
    return score_texts(docs, lambda: Scorer(held.value), text, keep_text=keep_text)


def label_lines(text: str, field: Field) -> list[tuple[str, float]]:
    """Lines of one text with the probability that each is good, for looking into a score."""
    x, _, per_text = Reader()([text])
    good, _, _ = marginals(x @ field.weights, field.pair, per_text)
    return list(zip(lines_of(text), good.tolist()))
