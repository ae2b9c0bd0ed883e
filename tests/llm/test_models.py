"""Learned scores on held-out rows, and the networks' pieces against slow versions."""

import itertools
import zlib

import numpy as np
import pytest

from parlance.llm import labelled, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def held(spark, rows, label, folds, fold):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    return [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]


def area(pairs):
    good = [s for s, _, y in pairs if y]
    bad = [s for s, _, y in pairs if not y]
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def test_toxicity_held_out(spark):
    rows = queries.op4(spark, SF).collect()
    assert len(rows) == 1000
    assert area(held(spark, rows, "toxic", 4, 2)) > 0.75


def test_quality_held_out(spark):
    rows = queries.op5(spark, SF).collect()
    pairs = held(spark, rows, "quality", 5, 0)
    assert area(pairs) > 0.95
    assert np.mean([p == y for _, p, y in pairs]) > 0.9


def sample(texts, labels):
    return labelled.Sample(texts, np.array(labels), np.ones(len(labels)))


TEXTS = ["good day to all of you"] * 0 + [f"word{i} nice thing here today" for i in range(60)] + [
    f"word{i} you stupid fool here" for i in range(60)]


@pytest.mark.parametrize("module,score", [(toxicity, "score_toxicity"), (quality, "score_quality")])
def test_odd_rows(spark, module, score):
    model = module.train(sample(TEXTS, [0] * 60 + [1] * 60))
    rows = [(1, None), (1, None), (2, ""), (3, " \n "), (None, "é" * 70000), (4, "you stupid fool"), (5, "a\n" * 3000)]
    df = spark.createDataFrame([(i, t, "old") for i, t in rows], "doc_id long, text string, score string")
    out = getattr(module, score)(df, model)
    got = out.collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if r.doc_id in (1, 2)}
    assert len(empty) == 1
    assert getattr(module, score)(df.limit(0), model).collect() == []
    kept = getattr(module, score)(df, model, keep_text=True)
    assert sorted(kept.columns) == sorted(df.columns)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_one_class_or_none(module):
    for texts, labels in ([], []), (["a b"], [1]), (["a b", "c"], [0, 0]):
        model = module.train(sample(texts, np.array(labels, int)))
        got = module.Scorer(model)(["x", "", "y z\nq"])
        assert np.ptp(got) < 1e-6 and ((0 <= got) & (got <= 1)).all()


def test_sample_bounds(spark):
    docs = spark.createDataFrame([(i, "t" * (i + 1)) for i in range(50)] + [(None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    keep = ~labelled.in_fold("doc_id", 4, 2)
    got = labelled.labelled_sample(docs, labels, "toxic", keep, per_class=(5, 3), max_chars=40)
    assert (got.labels == 0).sum() <= 5 and (got.labels == 1).sum() <= 3 and len(got.texts) > 0
    assert all(zlib.crc32(str(len(t) - 1).encode()) % 4 != 2 and len(t) <= 40 for t in got.texts)
    none = labelled.labelled_sample(docs, labels.limit(0), "toxic", keep)
    assert none.texts == [] and len(none.labels) == 0


def test_windows_cover_every_word():
    counts = np.array([0, 1, 32, 33, 48, 49, 500])
    first, size, owner = toxicity.window_starts(counts)
    heads = np.cumsum(counts) - counts
    for t, n in enumerate(counts):
        own = owner == t
        covered = {i for a, k in zip(first[own] - heads[t], size[own]) for i in range(a, a + k)}
        assert covered == set(range(n)) and size[own].max() <= toxicity.WINDOW


def test_network_gradients():
    """Backward pass against differences."""
    rng = np.random.default_rng(0)
    h, t, b = toxicity.HIDDEN, 5, 3
    p = {k: rng.normal(0, 0.5, s) for k, s in {
        "uf": (h, 3 * h), "ub": (h, 3 * h), "wa": (2 * h, h), "ba": (h,), "va": (h,), "w": (2 * h,), "b": (1,)}.items()}
    gf, gb = rng.normal(0, 1, (2, t, b, 3 * h))
    mask = (np.arange(t)[:, None] < np.array([5, 3, 0])).astype(float)[..., None]
    y, w = np.array([1, 0, 1]), np.ones(b)

    def loss():
        logit, _ = toxicity.judge(p, gf, gb, mask)
        return (np.log1p(np.exp(-np.abs(logit))) + np.maximum(logit, 0) - y * logit).mean()

    _, g, d_gf, d_gb = toxicity.gradients(p, gf, gb, mask, y, w)
    for own, grad in [*((p[k], g[k]) for k in p), (gf, d_gf), (gb, d_gb)]:
        for i in rng.choice(own.size, min(8, own.size), replace=False):
            at = np.unravel_index(i, own.shape)
            kept = own[at]
            own[at] = kept + 1e-5
            up = loss()
            own[at] = kept - 1e-5
            down = loss()
            own[at] = kept
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-6


def test_marginals_against_all_labelings():
    rng = np.random.default_rng(1)
    per_text = np.array([1, 4, 2, 6])
    emission, pair = rng.normal(0, 1, per_text.sum()), rng.normal(0, 1, (2, 2))
    good, joint, log_z = quality.marginals(emission, pair, per_text, edges=True)
    at, total, pairs = 0, 0.0, np.zeros((2, 2))
    for n in per_text:
        e = emission[at : at + n]
        weight, mass, own = 0.0, np.zeros(n), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=int(n)):
            s = np.exp(sum(x for x, l in zip(e, labels) if l) + sum(pair[a, b] for a, b in zip(labels, labels[1:])))
            weight += s
            mass += s * np.array(labels)
            for a, b in zip(labels, labels[1:]):
                own[a, b] += s
        assert np.allclose(good[at : at + n], mass / weight)
        pairs += own / weight
        total += np.log(weight)
        at += n
    assert np.allclose(joint, pairs) and abs(log_z - total) < 1e-9


def test_lines_are_labelled():
    clean, junk = "the cat sat on the mat and slept.", "BUY!! NOW!! BUY!! NOW!! $$$ %%% ###"
    texts = [clean + "\n" + clean] * 40 + [clean + "\n" + junk + "\n" + junk] * 40
    texts = [f"{t}\nline {i} of it" for i, t in enumerate(texts)]
    field = quality.train(sample(texts, [1] * 40 + [0] * 40))
    got = dict(quality.label_lines(f"{clean}\n{junk}\n{junk}", field))
    assert got[clean] > got[junk]
