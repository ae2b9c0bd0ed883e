import random

import pytest
from pyspark.sql import functions as F

from parlance.operators import evaluation as V


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def f1(o, n, m):
    p, r = (o / n if n else 0), (o / m if m else 0)
    return 2 * p * r / (p + r) if p + r else 0.0


def overlap(a, b):
    return sum(min(a.count(x), b.count(x)) for x in set(a))


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(7)
    out = [("", "a b"), ("a b", ""), ("", ""), ("a a b", "a b b"), ("Same Text!", "same text"), ("x", "x")]
    for _ in range(60):
        out.append(tuple(" ".join(rng.choices("abcde", k=rng.randint(0, 30))) for _ in range(2)))
    return out


def test_scores_match_brute_force(spark, cases):
    df = spark.createDataFrame([(i, p, r, "plan") for i, (p, r) in enumerate(cases)], "i int, pred string, ref string, section string")
    got = {r["i"]: r for r in V.word_errors(V.char_errors(V.score_pairs(df))).collect()}
    for i, (p, r) in enumerate(cases):
        a, b = p.lower().replace("!", "").split(), r.lower().replace("!", "").split()
        row = got[i]
        assert row["f1"] == pytest.approx(f1(overlap(a, b), len(a), len(b)))
        assert row["rouge1_f1"] == row["f1"]
        ga, gb = list(zip(a, a[1:])), list(zip(b, b[1:]))
        assert row["rouge2_f1"] == pytest.approx(f1(overlap(ga, gb), len(ga), len(gb)))
        assert row["rougeL_f1"] == pytest.approx(f1(lcs(a, b), len(a), len(b)))
        assert row["rougeL_f1"] <= row["rouge1_f1"] + 1e-12
        assert row["word_edits"] == edits(a, b)
        assert row["char_edits"] == edits(" ".join(a), " ".join(b))
        assert row["exact_match"] == float(a == b and a != [])
        assert row["section_presence_acc"] == float(bool(a) == bool(b))
        assert all(0 <= row[m] <= 1 for m in V.METRICS)


def test_missing_metrics_count_as_zero(spark):
    cols = "section string, " + ", ".join(f"{m} double" for m in V.METRICS)
    base = spark.createDataFrame([("plan", *[0.5] * 8)], cols)
    cand = spark.createDataFrame([("macro", *[0.25] * 8)], cols)
    got = {(r.section, r.metric): r.delta for r in V.compare_runs(base, cand).collect()}
    assert got[("plan", "f1")] == -0.5 and got[("macro", "f1")] == 0.25


def test_no_pairs_is_an_error(spark):
    a = spark.createDataFrame([(1, "x")], "k int, text string")
    b = spark.createDataFrame([(2, "x")], "k int, text string")
    with pytest.raises(ValueError):
        V.require_pairs(V.pair_predictions(a, b, ["k"]))


def test_languages_with_one_sample_are_left_out(spark):
    df = spark.createDataFrame([("a b", "a c", "en"), ("a", "a", "en"), ("x", "y", "mr")], "pred string, ref string, language string")
    got = V.error_by_language(df).collect()
    assert [(r.language, r.wer, r.n_samples) for r in got] == [("en", 33.33, 2)]
