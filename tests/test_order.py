import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.functions import text
from parlance.operators import intervals as I, ordering as O, speakers as S, splits as P, turns as T
from parlance.operators import glossary as G


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_prefix_equals_a_plain_window(spark, width):
    rng = random.Random(3)
    rows = [(s, i, rng.randint(0, 9), rng.choice([None, "x", "y"])) for s in range(5) for i in rng.sample(range(60), 17 if s else 50)]
    df = spark.createDataFrame(rows, "k int, o int, v int, s string")
    got = O.prefix(
        df, ["k"], ["o"], F.floor(F.col("o") / width), lag={"prev": F.col("v")},
        running_sum={"cum": F.col("v")}, last_value={"seen": F.col("s")}, position="pos",
        next_value={"ahead": F.col("s")},
        step_sum={"ups": (F.struct(F.col("v").alias("v")), lambda this, prev: this["v"] > prev["v"])},
    )
    w = Window.partitionBy("k").orderBy("o")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "*", F.lag("v").over(w).alias("prev"), F.sum("v").over(up).alias("cum"),
        (F.row_number().over(w) - 1).alias("pos"), F.last("s", ignorenulls=True).over(up).alias("seen"),
        F.first("s", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("ahead"),
        F.coalesce((F.col("v") > F.lag("v").over(w)).cast("long"), F.lit(0)).alias("_up"),
    ).withColumn("ups", F.sum("_up").over(up))
    cols = ["k", "o", "v", "s", "prev", "cum", "pos", "seen", "ahead", "ups"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


@pytest.mark.parametrize("n", [0, 1, 2, 9, 10, 101, 1000])
def test_splits_are_exact_and_disjoint(spark, n):
    df = spark.range(n).withColumn("payload", F.lit("x"))
    three = P.split_three_way(df, "id").collect()
    assert sorted(r.id for r in three) == list(range(n))
    count = lambda rows, s: sum(r.split == s for r in rows)
    assert count(three, "train") == int(n * 0.8) and count(three, "val") == int(n * 0.1)
    two = P.split_two_way(df, "id").collect()
    if n >= 10:
        assert sorted(r.id for r in two) == list(range(n)) and count(two, "train") == int(n * 0.8)
    else:
        assert count(two, "train") == n and count(two, "val") == min(n, 1)
    seq = P.split_sequential(df, "id").collect()
    cut = max(1, int(n * 0.8)) if n else 0
    assert sorted(r.id for r in seq if r.split == "train") == list(range(cut))
    assert sorted(r.id for r in seq if r.split == "val") == ([0] if n == 1 else list(range(cut, n)))


def test_splits_refine_the_cell_of_a_cut(spark):
    """One value of the first digit: the second digit finds the cut; negative and wide keys too."""
    from parlance.operators.ordering import cut_by_rank, long_digits

    df = spark.range(1000).withColumn("h", F.format_string("000%029d", F.col("id")))
    digits = [F.substring("h", 1, 3), F.substring("h", 30, 3)]
    got = cut_by_rank(df, digits, ["h"], [0.8, 0.1], ["a", "b", "c"]).collect()
    assert {r.id: r.split for r in got} == {i: "a" if i < 800 else "b" if i < 900 else "c" for i in range(1000)}
    keys = [-(2**62), -70000, -1, 0, 5, 65536, 2**33, 2**50, 2**62, 7]
    wide = spark.createDataFrame([(k,) for k in keys], "id long")
    got = cut_by_rank(wide, long_digits(F.col("id")), ["id"], [0.5], ["a", "b"]).collect()
    assert {r.id for r in got if r.split == "a"} == set(sorted(keys)[:5])


def test_split_does_not_depend_on_partitioning(spark):
    a = P.split_three_way(spark.range(0, 500, 1, 1), "id").collect()
    b = P.split_three_way(spark.range(0, 500, 1, 7), "id").collect()
    assert {(r.id, r.split) for r in a} == {(r.id, r.split) for r in b}


@pytest.mark.parametrize("n, top", [(3, 4), (4, 4), (5, 4), (100, 40)])
def test_head_tail(spark, n, top):
    df = spark.range(n).select(F.lit(1).alias("session_id"), F.col("id").alias("turn_id"))
    got = sorted(r.turn_id for r in T.head_tail_turns(df, top).collect())
    assert got == (list(range(n)) if n <= top else list(range(top // 2)) + list(range(n - top // 2, n)))


def test_group_limit_runs_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    assert "WindowGroupLimit" in plan_of(O.head_rows(df, ["k"], [F.col("id")], 5))


def brute_hints(chunks):
    q, r = chunks["q"], chunks["r"]
    n, start, end = len(q), chunks["start"], chunks["end"]
    sp, out, switches = "A", [], 0
    flip = {"A": "B", "B": "A"}
    for i in range(n):
        if i and start[i] - end[i - 1] > 1.5:
            sp, switches = flip[sp], switches + 1
        out.append(sp)
    if not switches and n >= 2:
        sp, cues = "A", 0
        for i in range(1, n):
            if (q[i - 1] and r[i]) or (i % 2 == 0 and cues == 0):
                sp, cues = flip[sp], cues + 1
            out[i] = sp
    if n >= 6 and max(out.count("A"), out.count("B")) / n >= 0.85:
        out = ["AB"[i % 2] for i in range(n)]
    return out


def test_speaker_hints_against_the_loop(spark):
    rng = random.Random(11)
    long = " ".join(["word"] * 20)
    rows, want = [], {}
    for s in range(60):
        n, at = rng.randint(1, 14), 0.0
        c = {"q": [], "r": [], "start": [], "end": []}
        for i in range(n):
            at += rng.choice([0.0, 1.4, 1.5, 1.6]) if s % 2 else 0.5
            said = rng.choice(["what now?", "yes", long, long + "?"])
            c["q"].append("?" in said), c["r"].append(said in ("yes", "what now?"))
            c["start"].append(at), c["end"].append(at + 1.0)
            rows.append((s, i, at, at + 1.0, said))
            at += 1.0
        want[s] = brute_hints(c)
    df = spark.createDataFrame(rows, "session_id int, chunk_id int, start_s double, end_s double, text string")
    got = {}
    for r in S.speaker_hints(df).orderBy("session_id", "chunk_id").collect():
        got.setdefault(r.session_id, []).append(r.speaker)
    assert got == want


def test_speaker_assignment_against_brute_force(spark):
    rng = random.Random(5)
    chunks, segs = [], []
    for s in range(4):
        for i in range(40):
            a = round(rng.uniform(0, 300), 1)
            chunks.append((s, i, a, round(a + rng.uniform(0.5, 40), 1)))
        for i in range(12):
            a = round(rng.uniform(0, 300), 1)
            segs.append((s, i, a, round(a + rng.choice([0.5, 5, 150]), 1), f"L{i % 3}"))
    c = spark.createDataFrame(chunks, "session_id int, chunk_id int, start_s double, end_s double")
    g = spark.createDataFrame(segs, "session_id int, seg_id int, start_s double, end_s double, label string")
    got = {(r.session_id, r.chunk_id): r.speaker for r in I.assign_speakers(c, g, 20.0).collect()}
    for s, i, a, b in chunks:
        mine = [x for x in segs if x[0] == s]
        best = max(mine, key=lambda x: (min(b, x[3]) - max(a, x[2]), -x[1]))
        if min(b, best[3]) - max(a, best[2]) <= 0:
            mid = (a + b) / 2
            best = min(mine, key=lambda x: (abs((x[2] + x[3]) / 2 - mid), x[1]))
        assert got[(s, i)] == best[4], (s, i)
    text_plan = plan_of(I.overlap_pairs(c, g, 20.0))
    assert "CartesianProduct" not in text_plan and "NestedLoop" not in text_plan


def test_intervals_of_any_length(spark):
    """Thirty years next to half seconds, on both sides, and an interval the wrong way round."""
    rng = random.Random(9)
    years = 30 * 365.25 * 86400
    chunks, segs = [], []
    for i in range(60):
        a = rng.choice([rng.uniform(0, 300), rng.uniform(0, years), -rng.uniform(0, 9000)])
        chunks.append((1, i, a, a + rng.choice([0.0, 0.5, 40.0, 86400.0, years])))
        b = rng.choice([rng.uniform(0, 300), rng.uniform(0, years), a, -rng.uniform(0, 9000)])
        segs.append((1, i, b, b + rng.choice([0.5, 150.0, 5e5, years]), f"L{i % 3}"))
    chunks += [(1, 60, 500.0, 100.0), (1, 61, None, 3.0), (2, 0, 0.0, years)]
    segs += [(1, 60, 900.0, 90.0, "L0"), (1, 61, 0.0, None, "L1")]
    c = spark.createDataFrame(chunks, "session_id int, chunk_id int, start_s double, end_s double")
    g = spark.createDataFrame(segs, "session_id int, seg_id int, start_s double, end_s double, label string")
    want = [
        (i, j, min(b, y) - max(a, x)) for s, i, a, b in chunks for t, j, x, y, _ in segs
        if s == t and None not in (a, b, x, y) and a <= b and x <= y and a < y and b > x
    ]
    for width in (60.0, 0.7):
        pairs = I.overlap_pairs(c, g, width)
        got = [(r.chunk_id, r.seg_id, r.overlap) for r in pairs.collect()]
        assert sorted(got) == sorted(want) and len(want) > 500
    placed = I._placed(g.select("session_id", "seg_id", "start_s", "end_s"), "start_s", "end_s", 60.0, "covers")
    assert placed.groupBy("seg_id").count().agg(F.max("count")).first()[0] < 1600
    labels = {r.chunk_id: r.speaker for r in I.assign_by_overlap(c.filter("session_id = 1"), g).collect()}
    for i in {i for i, _, _ in want}:
        best = max((x for x in want if x[0] == i), key=lambda x: (x[2], -x[1]))
        assert labels[i] == segs[best[1]][4]


def test_clinician_inference(spark):
    rows = [(1, 0, "A1", "i am tired"), (1, 1, "B1", "since when do you?"), (2, 5, "X", "hm"), (2, 6, "Y", "hm")]
    df = spark.createDataFrame(rows, "session_id int, chunk_id int, speaker string, text string")
    got = {r.session_id: r.doctor_speaker for r in S.doctor_speaker(df).collect()}
    assert got == {1: "B1", 2: "X"}


def test_topk_with_small_blocks_and_ties(spark, monkeypatch):
    """Tiles, blocks and groups smaller than the tables; terms that tie in different blocks."""
    rng = random.Random(2)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(8)]
    vectors = [vec() for _ in range(12)]
    terms = [(i, vectors[i % 12]) for i in range(30)] + [(99, [0.0] * 8)]
    queries = [(i, vec()) for i in range(30)]
    q = spark.createDataFrame(queries, "query_id long, vector array<double>")
    t = spark.createDataFrame(terms, "term_id long, vector array<double>")

    def cosine(a, b):
        n = sum(x * x for x in a) * sum(x * x for x in b)
        return round(sum(x * y for x, y in zip(a, b)) / n**0.5, 10) if n else 0.0

    want = {(i, j) for i, v in queries for j, _ in sorted(terms, key=lambda x: (-cosine(v, x[1]), x[0]))[:4]}
    for block, group, tile, cluster in ((4096, 20000, 1 << 21, 1024), (4, 7, 8, 99), (1, 1, 1, 99), (3, 7, 8, 4), (4096, 20000, 8, 1)):
        monkeypatch.setattr(G, "CLUSTER_TERMS", cluster)
        monkeypatch.setattr(G, "BLOCK_TERMS", block)
        monkeypatch.setattr(G, "GROUP_QUERIES", group)
        monkeypatch.setattr(G, "TILE", tile)
        assert {(r.query_id, r.term_id) for r in G.term_topk(q, t, 4).collect()} == want
    assert G.term_topk(q, t.limit(0), 4).collect() == []


def test_topk_opens_few_clusters(spark, monkeypatch):
    """Clustered vectors with copies: all rows as without clusters, most clusters left closed."""
    import numpy as np

    monkeypatch.setattr(G, "CLUSTER_TERMS", 40)
    monkeypatch.setattr(G, "BLOCK_TERMS", 64)
    monkeypatch.setattr(G, "GROUP_QUERIES", 50)
    rng = np.random.default_rng(8)
    hubs = rng.normal(size=(25, 16))
    near = lambda n: hubs[rng.integers(25, size=n)] * rng.uniform(0.1, 9, (n, 1)) + rng.normal(size=(n, 16)) * 0.05
    terms = np.vstack([near(1400), np.repeat(hubs[:1], 150, axis=0), np.zeros((3, 16))])
    asked = np.vstack([near(120), hubs[:5], np.zeros((2, 16)), -hubs[5:8]])
    rows = lambda vs, name: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vs)], f"{name} long, vector array<double>")
    q, t = rows(asked, "query_id"), rows(terms, "term_id")
    listed = lambda df: sorted((r.query_id, r.term_id, round(r.similarity, 9)) for r in df.collect())
    want = listed(G.term_topk(q, t, 6, clustered=False))
    assert len(want) == 6 * len(asked) and listed(G.term_topk(q, t, 6)) == want
    plain = q.filter(f"query_id < 125")
    placed, clusters = G.cluster_terms(t)
    assert clusters.size.sum() == len(terms) and clusters.size[-1] == 3
    start = G.opened_first(plain, clusters, 6)
    found = G._best(G._in_opened(start, placed, plain, clusters, 6), ["query_id"], "term_id", 6)
    opened = start.count() + G.opened_next(plain, found, clusters, 6).count()
    assert opened < 0.25 * 125 * (clusters.size > 0).sum()



def test_a_query_goes_once_to_a_block(spark, monkeypatch):
    """Many small clusters share few blocks, a large one has its own; nothing is lost or sent twice."""
    import numpy as np

    monkeypatch.setattr(G, "CLUSTER_TERMS", 10)
    monkeypatch.setattr(G, "BLOCK_TERMS", 60)
    monkeypatch.setattr(G, "FEW_BLOCKS", 4)
    monkeypatch.setattr(G, "MOST_TERMS", 100)
    rng = np.random.default_rng(5)
    terms = np.vstack([rng.normal(size=(300, 6)), np.repeat(np.eye(6)[:1], 250, axis=0)])
    rows = lambda vs, name: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vs)], f"{name} long, vector array<double>")
    q, t = rows(rng.normal(size=(40, 6)), "query_id"), rows(terms, "term_id")
    sent = []
    compare = G._compare
    monkeypatch.setattr(G, "_compare", lambda asked, offered, keys, k: (sent.append(asked), compare(asked, offered, keys, k))[1])
    listed = lambda df: sorted((r.query_id, r.term_id, round(r.similarity, 9)) for r in df.collect())
    got = listed(G.term_topk(q, t, 5))
    assert [df.count() for df in sent][0] <= 40 * 2 and all(df.count() <= 40 * 12 for df in sent)
    assert got == listed(G.term_topk(q, t, 5, clustered=False)) and len(got) == 200


def test_phrases_are_not_broadcast(spark, tmp_path):
    """Phrases out of texts that look small to Spark stay on the executors."""
    rows = [(i, "low mood and poor sleep, severe stress") for i in range(50)]
    spark.createDataFrame(rows, "k int, text string").write.parquet(str(tmp_path / "texts"))
    texts = spark.read.parquet(str(tmp_path / "texts"))
    glossary = spark.createDataFrame([("low mood",), ("stress",), ("sleep",)], "english string")
    for terms in (None, glossary):
        got = G.phrase_terms(texts, ["k"], glossary=terms)
        assert got.count() > 50
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_augmentation_plan(spark):
    clips = spark.createDataFrame([(i, f"c{i}.wav", "train" if i < 8 else "val") for i in range(10)], "id int, file_name string, split string")
    plan = P.augmentation_plan(clips, "id").collect()
    for i in range(10):
        mine = [r.augmented for r in plan if r.id == i]
        assert mine.count(None) == 1 and len(set(mine)) == len(mine) == (4 if i < 8 else 1)


def test_apply_model_hook(spark):
    df = spark.range(3)

    def model(batches):
        for pdf in batches:
            yield pdf.assign(y=pdf["id"] * 2)

    assert T.apply_model(df) is df
    assert sorted(r.y for r in T.apply_model(df, model, "id long, y long").collect()) == [0, 2, 4]


def test_waves(spark):
    import numpy as np

    from parlance.operators import waves as W

    x = [0.1, -0.4, 0.3, 0.2, -0.1]
    df = spark.createDataFrame([(1, x), (2, [0.0] * 5)], "id int, w array<float>")
    row = df.select(W.peak_normalise(F.col("w")).alias("p"), W.change_speed(F.col("w"), 0.5).alias("s"), W.shift_pitch(F.col("w"), -2.0).alias("t")).collect()
    assert row[0].p == pytest.approx(np.array(x) / 0.4 * 0.95, abs=1e-6) and row[1].p == [0.0] * 5
    assert row[0].s == pytest.approx(np.interp(np.linspace(0, 4, 10), np.arange(5), x), abs=1e-6)
    m = int(5 * 2 ** (2.0 / 12))
    mid = np.interp(np.linspace(0, 4, m), np.arange(5), x)
    assert row[0].t == pytest.approx(np.interp(np.linspace(0, m - 1, 5), np.arange(m), mid), abs=1e-6)
    long = spark.createDataFrame([(1, [float(v) for v in np.sin(np.arange(20000))])], "id int, w array<float>")
    noisy = np.array(W.add_noise(long, "id", "w", 20.0).first().w)
    again = np.array(W.add_noise(long.repartition(3), "id", "w", 20.0).first().w)
    clean = np.sin(np.arange(20000))
    snr = 10 * np.log10(np.mean(clean**2) / np.mean((noisy - clean) ** 2))
    assert abs(snr - 20) < 0.5 and (noisy == again).all()
    cuts = W.windows(long, "id", "w", rate=1000, window_s=8, overlap_s=1).orderBy("chunk_id").collect()
    assert [(c.start_s, c.end_s) for c in cuts] == [(0.0, 8.0), (7.0, 15.0), (14.0, 20.0)]


def test_long_sessions_never_become_one_string(spark):
    chunks = spark.range(10).select(F.lit(1).alias("session_id"), F.col("id").alias("chunk_id"), (F.col("id") * 61.0).alias("start_s"),
                                    F.when(F.col("id") < 5, "A").otherwise("B").alias("speaker"), F.lit("hm").alias("text"))
    rows = S.format_transcript(chunks).orderBy("chunk_id").collect()
    assert [r.heading is not None for r in rows] == [True] + [False] * 4 + [True] + [False] * 4
    assert rows[2].line == "  [02:02]  hm"


def test_preview(spark):
    assert spark.range(1).select(text.preview(F.lit("x" * 101))).first()[0] == "x" * 100 + "..."
