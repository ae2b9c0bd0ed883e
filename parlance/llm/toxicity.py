"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as two vectors: an embedding of the word and the maximum over embeddings of
its character n-grams. Forward and backward gated recurrent units read a window of words,
attention pools their states, a logistic unit judges the window. Windows overlap by half
and cover the whole text; the highest one judges the document. Trained in numpy.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from parlance.llm.common import Growing, mix64, spread_index
from parlance.llm.labelled import Sample, calibrate, score_texts, sigmoid
from parlance.llm.words import ChunkTable

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM = 8, 4, 4
GRAM_BUCKETS = 1 << 15
GRAMS = (3, 4, 5)
VOCABULARY = 8000
EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_/\\«»¡¿"


def core(chunk: str) -> str:
    """A chunk as a word: without punctuation around it, in lower case."""
    return chunk.strip(EDGE).lower()


def char_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte n-grams of ``^word$``, word after word, and how many each has."""
    raw = [b"^" + w.encode("utf-8", "surrogatepass") + b"$" for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    held, owner = [], []
    for n in GRAMS:
        counts = np.maximum(sizes - n + 1, 0)
        at = spread_index(starts, counts)
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) ^ flat[at + j]
        held.append((mix64(h) % np.uint64(GRAM_BUCKETS)).astype(np.int64))
        owner.append(np.repeat(np.arange(len(words)), counts))
    held, owner = np.concatenate(held), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return held[order], np.bincount(owner, minlength=len(words))


@dataclass
class Network:
    """Parameters by name, the vocabulary, and the fit from logits to scores."""

    p: dict[str, np.ndarray]
    vocabulary: dict[str, int]
    slope: float = 1.0
    offset: float = 0.0

    def inputs(self, words: list[str]) -> np.ndarray:
        """Vectors of words: embedding next to the pooled characters."""
        known = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        grams, counts = char_grams(words)
        pooled = np.zeros((len(words), CHAR_DIM), np.float32)
        has = counts > 0
        if has.any():
            at = (np.cumsum(counts) - counts)[has]
            pooled[has] = np.maximum.reduceat(self.p["chars"][grams], at, axis=0)
        return np.concatenate((self.p["words"][known], pooled), axis=1)


def _steps(gx: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool):
    """States of a gated recurrent unit over axis 0 of projected inputs (T, B, 3h)."""
    steps, batch, _ = gx.shape
    h = np.zeros((batch, HIDDEN), gx.dtype)
    states = np.empty((steps, batch, HIDDEN), gx.dtype)
    kept = []
    for t in range(steps):
        hu = h @ u
        gates = sigmoid(gx[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        hn = hu[:, 2 * HIDDEN :]
        n = np.tanh(gx[t, :, 2 * HIDDEN :] + r * hn)
        new = (n + z * (h - n)) * mask[t]
        if keep:
            kept.append((h, z, r, hn, n))
        h = new + h * (1 - mask[t])
        states[t] = h
    return states, kept


def _steps_back(d_states, kept, mask, u):
    """Gradients of projected inputs and of ``u``."""
    steps, batch, _ = d_states.shape
    d_gx = np.zeros((steps, batch, 3 * HIDDEN), d_states.dtype)
    d_u, d_h = np.zeros_like(u), np.zeros((batch, HIDDEN), d_states.dtype)
    for t in range(steps - 1, -1, -1):
        h, z, r, hn, n = kept[t]
        d_h = d_h + d_states[t]
        d_new = d_h * mask[t]
        d_n = d_new * (1 - z) * (1 - n * n)
        d_z = d_new * (h - n) * z * (1 - z)
        d_r = d_n * hn * r * (1 - r)
        d_hu = np.concatenate((d_z, d_r, d_n * r), axis=1)
        d_gx[t] = np.concatenate((d_z, d_r, d_n), axis=1)
        d_u += h.T @ d_hu
        d_h = d_h * (1 - mask[t]) + d_new * z + d_hu @ u.T
    return d_gx, d_u


def judge(p, gf, gb, mask, keep=False):
    """Logits of windows, given their projected inputs for both directions (T, B, 3h)."""
    sf, kf = _steps(gf, mask, p["uf"], keep)
    sb, kb = _steps(gb[::-1], mask[::-1], p["ub"], keep)
    states = np.concatenate((sf, sb[::-1]), axis=2)
    a = np.tanh(states @ p["wa"] + p["ba"])
    e = (a @ p["va"])[..., None]
    e = np.exp(e - e.max(axis=0)) * mask
    alpha = e / np.maximum(e.sum(axis=0), 1e-9)
    pooled = (alpha * states).sum(axis=0)
    logit = pooled @ p["w"] + p["b"][0]
    return logit, (kf, kb, states, a, alpha, pooled) if keep else None


def gradients(p, gf, gb, mask, y, weights):
    """Loss gradients: by parameter, and of the projected inputs of both directions."""
    logit, (kf, kb, states, a, alpha, pooled) = judge(p, gf, gb, mask, keep=True)
    d = (weights * (sigmoid(logit) - y) / len(y)).astype(gf.dtype)
    g = {"w": pooled.T @ d, "b": np.array([d.sum()], gf.dtype)}
    d_pool = d[:, None] * p["w"]
    d_states = alpha * d_pool
    d_alpha = (states * d_pool).sum(axis=2, keepdims=True)
    d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
    d_a = d_e * p["va"] * (1 - a * a)
    g["va"] = np.tensordot(d_e[..., 0], a, axes=([0, 1], [0, 1]))
    g["wa"] = np.tensordot(states, d_a, axes=([0, 1], [0, 1]))
    g["ba"] = d_a.sum(axis=(0, 1))
    d_states = d_states + d_a @ p["wa"].T
    d_gf, g["uf"] = _steps_back(d_states[..., :HIDDEN], kf, mask, p["uf"])
    d_gb, g["ub"] = _steps_back(d_states[::-1, :, HIDDEN:], kb, mask[::-1], p["ub"])
    return logit, g, d_gf, d_gb[::-1]


def window_starts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and text of every window; an empty text has one empty window."""
    per = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    place = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    owner = np.repeat(np.arange(len(counts)), per)
    first = (np.cumsum(counts) - counts)[owner] + place * STRIDE
    return first, np.minimum(WINDOW, counts[owner] - place * STRIDE), owner


class Scorer:
    """Highest window logit of each text; words are projected once per worker."""

    def __init__(self, net: Network, batch: int = 2048) -> None:
        self.net, self.batch = net, batch
        self.table = ChunkTable(self._new)

    def _new(self):
        # Row 0 pads windows.
        self.gf, self.gb = (Growing(np.float32, 3 * HIDDEN) for _ in range(2))
        for g in (self.gf, self.gb):
            g.add(np.zeros((1, 3 * HIDDEN), np.float32))
        return self._learn

    def _learn(self, fresh: list[str]) -> None:
        p = self.net.p
        for i in range(0, len(fresh), 20_000):
            x = self.net.inputs([core(c) for c in fresh[i : i + 20_000]])
            self.gf.add(x @ p["wf"] + p["bf"])
            self.gb.add(x @ p["wb"] + p["bb"])

    def windows(self, texts: list[str]):
        codes, counts = self.table.encode(texts)
        first, size, owner = window_starts(counts)
        padded = np.concatenate((codes + 1, np.zeros(WINDOW, np.int64)))
        return padded, first, size, owner

    def logits(self, padded, first, size) -> np.ndarray:
        out = np.empty(len(first), np.float32)
        steps = np.arange(WINDOW)
        gf, gb = self.gf.view(), self.gb.view()
        for i in range(0, len(first), self.batch):
            f, n = first[i : i + self.batch], size[i : i + self.batch]
            long = max(1, int(n.max()))
            mask = (steps[:long, None] < n)[..., None].astype(np.float32)
            at = padded[np.minimum(f + steps[:long, None], len(padded) - 1)]
            at = at * (mask[..., 0] > 0)
            out[i : i + self.batch] = judge(self.net.p, gf[at], gb[at], mask)[0]
        return out

    def __call__(self, texts: list[str]) -> np.ndarray:
        padded, first, size, owner = self.windows(texts)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, self.logits(padded, first, size))
        return sigmoid(self.net.slope * best + self.net.offset)


def _odds(pos: np.ndarray, neg: np.ndarray, n1: int, n0: int, shrink: float) -> np.ndarray:
    """How much oftener features occur in documents of label 1: root of the likelihood
    ratio, with the sign of the difference; what chance gives is 0."""
    seen, share = pos + neg, n1 / max(1, n1 + n0)

    def part(n, expected):
        return n * np.log(np.maximum(n, 1e-9) / np.maximum(expected, 1e-9))

    root = np.sqrt(np.maximum(2 * (part(pos, seen * share) + part(neg, seen * (1 - share))), 0))
    return np.sign(pos - seen * share) * np.maximum(0.0, np.minimum(root, 12.0) - shrink) / 3


class _Corpus:
    """The sample as numbers: words, their n-grams, windows and their labels."""

    def __init__(self, sample: Sample) -> None:
        codes: dict[str, int] = {"": 0}
        split = [[codes.setdefault(core(c), len(codes)) for c in t.split()] for t in sample.texts]
        self.words, self.y = list(codes), sample.labels
        self.counts = np.fromiter(map(len, split), np.int64, len(split))
        self.flat = np.array([c for own in split for c in own], np.int64)
        self.codes = np.concatenate((self.flat, np.zeros(WINDOW, np.int64)))
        grams, self.gram_n = char_grams(self.words)
        self.grams = grams.astype(np.int32)
        self.gram_at = np.cumsum(self.gram_n) - self.gram_n
        self.first, self.size, self.owner = window_starts(self.counts)
        self.fit = np.array(
            [int(hashlib.md5(t.encode()).hexdigest(), 16) % 5 != 0 for t in sample.texts], bool
        )

    def grams_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.gram_n[words]
        return self.grams[spread_index(self.gram_at[words], n)], n

    def spread(self) -> tuple[np.ndarray, np.ndarray]:
        """Documents of label 0 and 1 that hold each word, and each n-gram bucket."""
        words = np.zeros((2, len(self.words)))
        grams = np.zeros((2, GRAM_BUCKETS))
        ends = np.cumsum(self.counts)
        for d in np.flatnonzero(self.fit):
            own = np.unique(self.flat[ends[d] - self.counts[d] : ends[d]])
            words[self.y[d], own] += 1
            grams[self.y[d], np.unique(self.grams_of(own)[0])] += 1
        return words, grams

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words (T, B) of windows and their mask (T, B, 1)."""
        steps = np.arange(WINDOW)[:, None]
        mask = steps < self.size[rows]
        at = np.minimum(self.first[rows] + steps, len(self.codes) - 1)
        return self.codes[at] * mask, mask[..., None].astype(np.float32)

    def blocks(self, size: int = 4096):
        for i in range(0, len(self.first), size):
            yield np.arange(i, min(i + size, len(self.first)))


def _inputs(p, corpus, known, words):
    """Vectors of the given words, and what their gradients need."""
    grams, n = corpus.grams_of(words)
    own = p["chars"][grams]
    pooled = np.zeros((len(words), CHAR_DIM), np.float32)
    has = n > 0
    pooled[has] = np.maximum.reduceat(own, (np.cumsum(n) - n)[has], axis=0)
    x = np.concatenate((p["words"][known[words]], pooled), axis=1)
    return x, (grams, n, own, pooled)


def _batch(p, corpus, known, rows, y, weights):
    at, mask = corpus.place(rows)
    words, back = np.unique(at, return_inverse=True)
    back = back.reshape(at.shape)
    x, (grams, n, own, pooled) = _inputs(p, corpus, known, words)
    gf, gb = ((x @ p[f"w{d}"] + p[f"b{d}"])[back] for d in "fb")
    _, g, d_gf, d_gb = gradients(p, gf, gb, mask, y, weights)
    d_x = 0
    for d, part in (("f", d_gf), ("b", d_gb)):
        flat = part.reshape(-1, 3 * HIDDEN)
        per = np.stack(
            [np.bincount(back.ravel(), flat[:, j], len(words)) for j in range(3 * HIDDEN)], axis=1
        ).astype(np.float32)
        g[f"w{d}"], g[f"b{d}"] = x.T @ per, per.sum(axis=0)
        d_x = d_x + per @ p[f"w{d}"].T
    g["words"] = np.zeros_like(p["words"])
    np.add.at(g["words"], known[words], d_x[:, :WORD_DIM])
    owner = np.repeat(np.arange(len(words)), n)
    g["chars"] = np.zeros_like(p["chars"])
    np.add.at(g["chars"], grams, (own == pooled[owner]) * d_x[owner, WORD_DIM:])
    return g


def train(
    sample: Sample, seed: int = 1, rounds: int = 2, epochs: int = 4, rate: float = 0.01
) -> Network:
    """Fits the network on a sample; every fifth document only serves the final fit.

    Labels belong to documents, so a document of label 1 takes part with its highest
    window, one of label 0 with its highest two and a few random ones; both are chosen
    anew in each round. The first choice, and the first dimension of both embeddings, come
    from how much oftener a word or n-gram occurs in documents of label 1. A sample
    without both labels leaves a network that gives every text the same score.
    """
    rng = np.random.default_rng(seed)

    def small(scale, *shape):
        return rng.normal(0, scale, shape).astype(np.float32)

    dim = WORD_DIM + CHAR_DIM
    p = {"words": np.zeros((1, WORD_DIM), np.float32), "chars": small(0.03, GRAM_BUCKETS, CHAR_DIM)}
    for d in "fb":
        p[f"w{d}"], p[f"u{d}"] = small(0.4, dim, 3 * HIDDEN), small(0.3, HIDDEN, 3 * HIDDEN)
        p[f"b{d}"] = np.zeros(3 * HIDDEN, np.float32)
    p["wa"], p["ba"] = small(0.4, 2 * HIDDEN, HIDDEN), np.zeros(HIDDEN, np.float32)
    p["va"], p["w"], p["b"] = small(0.4, HIDDEN), small(0.4, 2 * HIDDEN), np.zeros(1, np.float32)
    net = Network(p, {})
    y = sample.labels
    if len(set(y.tolist())) < 2:
        p["w"][:] = 0
        net.offset = float(np.log(0.01 + (y == 1).sum()) - np.log(0.99 + (y == 0).sum())) if len(y) else -2.0
        return net

    corpus = _Corpus(sample)
    fit, owner = corpus.fit, corpus.owner
    per_word, per_gram = corpus.spread()
    n1, n0 = int((fit & (y == 1)).sum()), int((fit & (y == 0)).sum())
    word_odds = _odds(per_word[1], per_word[0], n1, n0, 4.0)
    p["chars"][:, 0] = _odds(per_gram[1], per_gram[0], n1, n0, 4.5)
    often = per_word.sum(axis=0)
    order = np.lexsort((-often, -np.abs(word_odds)))
    common = [int(w) for w in order[: VOCABULARY + 1] if often[w] >= 3 and w > 0]
    known = np.zeros(len(corpus.words), np.int64)
    known[common] = np.arange(1, len(common) + 1)
    net.vocabulary = {corpus.words[w]: int(known[w]) for w in common}
    p["words"] = small(0.05, len(common) + 1, WORD_DIM)
    p["words"][0], p["words"][1:, 0] = 0, word_odds[common]

    every = np.arange(len(corpus.words))
    first_view = _inputs(p, corpus, known, every)[0]
    value = np.maximum(first_view[:, 0], first_view[:, WORD_DIM])
    value[0] = -9
    score = np.concatenate([value[corpus.place(r)[0]].max(axis=0) for r in corpus.blocks()])
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    tick = 0
    for _ in range(rounds):
        rank = np.lexsort((-score, owner))
        nth = np.arange(len(rank)) - np.searchsorted(owner[rank], owner[rank])
        label, free = y[owner[rank]], rng.random(len(rank))
        some = (label == 1) & (nth < 1) | (label == 0) & ((nth < 2) | (nth < 12) & (free < 0.2))
        chosen = rank[fit[owner[rank]] & some]
        # Small samples get smaller steps and enough of them.
        size = 256 if len(chosen) > 4096 else 64
        passes = max(epochs, -(-100 * size // max(1, len(chosen))))
        gain = np.clip((y[owner[chosen]] == 0).sum() / 3 / max(1, (y[owner[chosen]] == 1).sum()), 1, 8)
        for _ in range(passes):
            shuffled = rng.permutation(chosen)
            for i in range(0, len(shuffled), size):
                rows = shuffled[i : i + size]
                tick += 1
                label = y[owner[rows]]
                weights = np.where(label == 1, gain, 1.0)
                for k, g in _batch(p, corpus, known, rows, label, weights).items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    step = rate * np.sqrt(1 - 0.99**tick) / (1 - 0.9**tick)
                    # The tables have many rows and few examples for each.
                    step = step * 0.05 if k in ("words", "chars") else step
                    p[k] -= (step * m / (np.sqrt(v) + 1e-7)).astype(np.float32)
                p["words"][0] = 0
        x = _inputs(p, corpus, known, every)[0]
        gf, gb = (x @ p[f"w{d}"] + p[f"b{d}"] for d in "fb")
        blocks = (corpus.place(r) for r in corpus.blocks())
        score = np.concatenate([judge(p, gf[at], gb[at], mask)[0] for at, mask in blocks])
    best = np.full(len(y), -np.inf)
    np.maximum.at(best, owner, score)
    held = ~fit if len(set(y[~fit].tolist())) == 2 else np.ones(len(y), bool)
    net.slope, net.offset = calibrate(
        best[held], y[held], sample.weights[held], float(np.average(y, weights=sample.weights))
    )
    return net


def score_toxicity(
    docs: DataFrame, net: Network, text: str = "text", keep_text: bool = False, score: str = "score"
) -> DataFrame:
    """The rows with a score (0 to 1) in place of their text, or next to it.

    Every word of every text is in a window; a text is as toxic as its worst window. Null
    and empty texts have one empty window and get the score it has. Repeated rows get the
    same score, other columns pass through, a column of the score's name is replaced, an empty
    table gives an empty table.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)
    return score_texts(docs, lambda: Scorer(held.value), text, score, keep_text)
