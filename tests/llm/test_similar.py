"""Similarity join against all pairs, components, and the pipeline against its stages."""

import random

import corpus_pipeline
import pytest
from parlance.llm import components, jaccard_join, packing, queries

SF = "/root/testdata/sf0.001"


def grams(text, words=5):
    w = [x for x in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
         .replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    if not w:
        return set()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or {tuple(w)}


def brute(texts, percent=75):
    sets = [grams(t) for t in texts]
    label = list(range(len(texts)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = top(i), top(j)
                label[max(x, y)] = min(x, y)
    return [(len(s), top(i)) for i, s in enumerate(sets)]


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(n):
        base = [word() for _ in range(rng.randrange(1, 120))]
        if rng.random() < 0.4:
            base += passage
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            own = list(base)
            for _ in range(rng.randrange(1 + len(own) // 20)):
                own[rng.randrange(len(own))] = word()
            texts.append(rng.choice([" ", "\n", " \t"]).join(own).upper())
    base = [word() for _ in range(80)]
    for _ in range(60):  # a crowd around one text
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(80)] = word()
        texts.append(" ".join(own))
    texts += [None, "", " \n", "one", "One", "one two", "a\xa0b c d e f", texts[0], texts[0]]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,group", [(1, 256), (2, 8)])
def test_matches_all_pairs(spark, monkeypatch, seed, group):
    monkeypatch.setattr(jaccard_join, "GROUP", group)
    texts = corpus(seed, 60)
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n int")
    got = {r.id: (r.n, r.component_id) for r in jaccard_join.similar_groups(df.repartition(3)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


@pytest.mark.parametrize("group", [8, 256])
def test_passages_in_all_rows(spark, monkeypatch, group):
    """Sets made of passages that many rows hold: every token is crowded."""
    monkeypatch.setattr(jaccard_join, "GROUP", group)
    rng = random.Random(11)
    passages = [[f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(8, 30))] for _ in range(9)]
    texts = []
    for _ in range(160):
        own = rng.sample(passages, rng.randrange(1, 6))
        extra = [f"x{rng.randrange(10**6)}" for _ in range(rng.choice([0, 0, 3, 9]))]
        texts.append(" ".join([*passages[0], *[w for p in own for w in p], *extra]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: (r.n, r.component_id) for r in jaccard_join.similar_groups(df.repartition(3)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_rows_keep_their_numbers(spark, monkeypatch, tmp_path):
    """Files are dealt to tasks in another way by each job, as when executors come and go."""
    texts = corpus(3, 60)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    df.repartition(6).write.parquet(str(tmp_path / "docs"))
    real, sizes = jaccard_join.settle, iter(["128m", "1m", "2k"] * 99)
    key = "spark.sql.files.maxPartitionBytes"

    def settle(df, name):
        out = real(df, name)
        spark.conf.set(key, next(sizes))
        return out

    monkeypatch.setattr(jaccard_join, "settle", settle)
    docs = spark.read.parquet(str(tmp_path / "docs"))
    spark.conf.set(key, "1k")
    try:
        got = {r.id: (r.n, r.component_id) for r in jaccard_join.similar_groups(docs).collect()}
        left = {r.doc_id for r in jaccard_join.keep_one(docs).collect()}
    finally:
        spark.conf.unset(key)
    want = brute(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert left == {i for i, (n, c) in enumerate(want) if not n or i == c}


def test_one_of_each_group_stays(spark):
    text = "one two three four five six seven eight"
    rows = [(3, text), (2, text.upper()), (2, text), (9, "other words entirely"), (None, None), (None, ""), (None, text)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, component_id string")
    left = jaccard_join.keep_one(df)
    assert left.columns == df.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["2", "9", "None", "None"]
    assert jaccard_join.keep_one(df.limit(0)).collect() == []


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 50), (70, 70), (61, 60)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 60: 50, 61: 50}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_stages_on_odd_tables(spark):
    """Nulls, empty and long texts, repeats, clashing names; and no rows at all."""
    long = "many words in here " * 9000
    rows = [(1, None), (None, "a clean line of words here"), (2, ""), (3, long), (3, long), (4, "Some other text"), (5, "some OTHER text")]
    df = spark.createDataFrame([(i, t, -7.0, 4, "en") for i, t in rows], "doc_id long, text string, score double, __row int, lang string")
    docs, empty = df, df.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs, none = (corpus_pipeline.scratch(spark, "odd") for _ in range(2))
        stage(spark, df, SF).write.parquet(docs)
        stage(spark, empty, SF).write.parquet(none)
        out = spark.read.parquet(docs)
        assert spark.read.parquet(none).collect() == []
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in df.collect()}
            continue
        assert out.columns == df.columns
        assert {(r["score"], r["__row"], r.lang) for r in out.collect()} == {(-7.0, 4, "en")}
        df, empty = out, spark.read.parquet(none)
    assert sorted(r.doc_id or 0 for r in df.collect()) == [0, 2, 3, 5]


def test_pipeline(spark):
    """Each stage against what its operator, or brute force, says about its input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        path = corpus_pipeline.scratch(spark, "test")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == given
            assert {tuple(r) for r in seen[name][1]} <= {tuple(r) for r in before}
    before, after = seen["exact dedup"]
    best = {}
    for r in before:
        key = r.text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        best[key] = max(best.get(key, -1), r.doc_id)
    assert {r.doc_id for r in after} == set(best.values())
    before, after = seen["near dedup"]
    before = sorted(before, key=lambda r: r.doc_id)
    roots = {root for _, root in brute([r.text for r in before])}
    assert {r.doc_id for r in after} == {before[i].doc_id for i in roots}
    before, after = seen["packing"]
    assert sum(r.length for r in after) == sum({r.doc_id: r.doc_tokens for r in after}.values())
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    assert len(seen["decontamination"][1]) < len(seen["decontamination"][0])
    assert corpus_pipeline.ORACLE_SQL is None and packing and queries
