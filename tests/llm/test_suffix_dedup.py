"""Repeated strings against a dictionary of all strings."""

import hashlib
import random
import string
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance import session
from parlance.llm import bwt, queries, suffix_dedup

SF = "/root/testdata/sf0.001"


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, kept) per text."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d, x in enumerate(data):
        for i in range(len(x) - length + 1):
            seen.setdefault(x[i : i + length], []).append((d, i))
    gone = [np.zeros(len(x), bool) for x in data]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + length] = True
    out = []
    for x, g in zip(data, gone):
        spans = int(g[:1].sum()) + int((g[1:] & ~g[:-1]).sum())
        out.append((len(x), int(g.sum()), spans, np.frombuffer(x, np.uint8)[~g].tobytes()))
    return out


def run(spark, texts, parts=3, **options):
    data = [(i, t, 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "doc_id long, text string, n_spans int").repartition(parts)
    got = suffix_dedup.drop_repeats(df, **options).collect()
    return [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sorted(got)]


def corpus(seed, n=40):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcé ") for _ in range(k))
    shared = [word(rng.randrange(20, 120)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [word(rng.randrange(0, 60))]
        for _ in range(rng.randrange(4)):
            parts += [rng.choice(shared), word(rng.randrange(0, 40))]
        texts.append("".join(parts))
    texts += [None, "", "a" * 300, "ab" * 150, texts[0], texts[1], texts[1][3:], "a" * 39, "é" * 20]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    texts = corpus(seed)
    assert run(spark, texts, length=40, anchor=12) == brute(texts, 40)


def test_rows_keep_their_numbers(spark, monkeypatch, tmp_path):
    """Files are dealt to tasks in another way by each job, as when executors come and go."""
    texts = corpus(3)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    df.repartition(6).write.parquet(str(tmp_path / "docs"))
    real, sizes = suffix_dedup.settle, iter(["128m", "1m", "2k", "128m"] * 9)
    key = "spark.sql.files.maxPartitionBytes"

    def settle(df, name):
        out = real(df, name)
        spark.conf.set(key, next(sizes))
        return out

    monkeypatch.setattr(suffix_dedup, "settle", settle)
    spark.conf.set(key, "1k")
    try:
        got = suffix_dedup.drop_repeats(spark.read.parquet(str(tmp_path / "docs")), length=40, anchor=12).collect()
    finally:
        spark.conf.unset(key)
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sorted(got)] == brute(texts, 40)


def test_crowded_anchors(spark, monkeypatch):
    """With every anchor crowded, strings are compared one by one; the result is the same."""
    monkeypatch.setattr(suffix_dedup, "CROWD", 0)
    texts = corpus(3)
    assert run(spark, texts, length=40, anchor=12) == brute(texts, 40)


def test_small_shards(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD", 100)
    monkeypatch.setattr(suffix_dedup, "MOST", 10**9)
    texts = corpus(4)
    packed = run(spark, texts, parts=1, length=40, anchor=12)
    assert packed == brute(texts, 40)


def shuffle_files(spark):
    """Sizes of the shuffle files that are there."""
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    folders = [Path(str(d)) for d in env.blockManager().diskBlockManager().localDirs()]
    return {f: f.stat().st_size for d in folders for f in d.rglob("shuffle_*.data")}


def test_shuffles_of_settled_tables_go(spark):
    before = shuffle_files(spark)
    session.settle(spark.range(20000).groupBy(F.col("id") % 999).count(), "counted")
    new = shuffle_files(spark).keys() - before.keys()
    assert new
    session.free_shuffles(spark)
    until = time.time() + 5
    while time.time() < until and any(f.exists() for f in new):
        time.sleep(0.1)
    assert not any(f.exists() for f in new)


def test_texts_are_shuffled_once(spark, monkeypatch):
    """Shuffle files of the whole run, had Spark removed none of them meanwhile."""
    rng = random.Random(6)
    word = lambda k: "".join(rng.choices(string.ascii_letters + string.digits, k=k))
    texts = [word(1500) for _ in range(2000)]
    texts[7] = texts[7][:700] + texts[1900][900:]
    monkeypatch.setattr(suffix_dedup, "free_shuffles", lambda spark: None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = shuffle_files(spark)
    try:
        got = suffix_dedup.drop_repeats(df, with_text=False)
        rows = {r.doc_id: r.n_removed for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    written = sum(size for f, size in shuffle_files(spark).items() if f not in before)
    assert {k: v for k, v in rows.items() if v} == {7: 600, 1900: 600}
    assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString()
    assert written < 1.6 * sum(map(len, texts))


def test_pieces_travel_squeezed():
    rng = random.Random(7)
    words = ["".join(rng.choices(string.ascii_lowercase, k=6)) for _ in range(60)]
    said = [" ".join(rng.choices(words, k=40)).encode() for _ in range(200)]
    content = [s + b"-" + said[0][:200] for s in said[1:]] + [said[5]]
    n = np.arange(len(content))
    widths = np.array([len(c) for c in content])
    kept, sent = suffix_dedup._share([(np.full(len(n), 3, np.uint64), n, n * 0, widths, content)], 1)
    assert len(kept) == 0 and sent["content"].str.len().sum() < 0.5 * widths.sum()
    met = suffix_dedup._meet(sent, 200)
    got = np.zeros(len(n), int)
    for ref, x, y in met:
        got[ref] += y - x
    want = brute([c.decode() for c in content], 200)
    assert got.tolist() == [w[1] for w in want]


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    want = brute([r.text for r in docs], 200)
    got = {r.doc_id: r for r in queries.op2(spark, SF).collect()}
    assert len(got) == len(docs)
    assert sum(w[1] for w in want) > 0
    for r, w in zip(docs, want):
        g = got[r.doc_id]
        assert (g.n_bytes, g.n_removed, g.n_spans) == w[:3]
        assert g.kept_sha256 == hashlib.sha256(w[3]).hexdigest()


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x" * 50), (1, "x" * 50), (None, None)], "doc_id long, text string")
    got = suffix_dedup.drop_repeats(df, length=50, anchor=10).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 50), (1, 50)]
    assert suffix_dedup.drop_repeats(df.limit(0)).collect() == []


def test_merged_transforms_equal_one():
    rng = np.random.default_rng(0)
    for _ in range(60):
        strings = [bytes(rng.integers(0, 3, rng.integers(0, 30)).astype(np.uint8)) for _ in range(7)]

        def made(part, base):
            sizes = np.array([len(s) for s in part], np.int64)
            return bwt.transform(np.frombuffer(b"".join(part), np.uint8), sizes, base)

        parts, base = [], 0
        for i in range(0, 7, 2):
            parts.append(made(strings[i : i + 2], base))
            base += sum(len(s) + 1 for s in strings[i : i + 2])
        merged, whole = bwt.merge_all(parts), made(strings, 0)
        assert (merged.place == whole.place).all() and (merged.bwt == whole.bwt).all()
        text = b"".join(s + b"\xff" for s in strings)
        ends = [i for i, c in enumerate(text) if c == 255]
        for depth in (1, 3, 5, 8):
            level = bwt.repeated_intervals(merged, depth)
            kept = [(v, text[p : p + depth]) for v, p in zip(level, merged.place)
                    if not any(p <= e < p + depth for e in ends)]
            assert len(set(kept)) == len({s for _, s in kept}) == len({v for v, _ in kept})
