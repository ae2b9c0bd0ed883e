"""URL rules, exact copies, chat formatting, decontamination on small tables."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from check import TABLES, rows_of, same_type
from parlance.llm import chat, decontamination, exact_dedup, queries, url_filters

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got, cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(queries.ORACLES[name])
    kinds = {d[0]: str(d[1]) for d in cur.description}
    want, want_cols = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert cols == want_cols and got == want
    assert all(same_type(t, kinds[c]) for c, t in df.dtypes)


# --- URL rules

def rule_of(rules, url):
    """Longest fitting rule by trying all."""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules
            if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_rules_against_trying_all(spark):
    rng = random.Random(5)
    label = lambda: rng.choice(["a", "b", "ab", "www", "x-1"])
    host = lambda n: ".".join([*[label() for _ in range(rng.randrange(n))], rng.choice(["com", "net", "co"])])
    path = lambda: rng.choice(["", "/", "/a", "/a/", "/a/b", "/b/"])
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(3), path()) for _ in range(60))}.values())
    urls = [f"http://{host(4)}{path()}{rng.choice(['', '?q', '#f'])}" for _ in range(400)]
    urls += ["https://hot.a.com/a/b/c"] * 200
    urls += [None, "", "a.com/x", "HTTP://A.COM/A", "http://", "http://?x", "http://a.com.", "x://b@a.com:80/a"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    table = spark.createDataFrame(rules + [(None, "/", "block"), ("", None, "block"), rules[0]], "host string, path string, verdict string")
    got = url_filters.judge_urls(pages.repartition(3), table).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == rule_of(rules, urls[r.page_id]), r


def test_rules_on_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [r.verdict for r in url_filters.judge_urls(pages, none, default="block").collect()] == ["block"]
    assert url_filters.judge_urls(pages.limit(0), none).collect() == []


# --- exact copies

def test_exact_groups(spark):
    rows = [(1, "A b"), (2, "a B"), (2, "a B"), (3, None), (4, ""), (None, "a b"), (5, "É"), (6, "é"), (7, "x" * 99999), (8, "X" * 99999)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, keep_id string")
    got = sorted((r.id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect())
    assert got == [
        (0, 2, 4, False), (1, 2, 4, False), (2, 2, 4, True), (2, 2, 4, True), (3, 4, 2, False),
        (4, 4, 2, True), (5, 5, 1, True), (6, 6, 1, True), (7, 8, 2, False), (8, 8, 2, True),
    ]
    stay = exact_dedup.drop_copies(df)
    assert stay.columns == df.columns
    assert sorted(r.doc_id for r in stay.collect()) == [2, 4, 5, 6, 8]
    assert exact_dedup.exact_groups(df.limit(0)).collect() == []
    nulls = spark.createDataFrame([(None, "q"), (None, "q")], "doc_id long, text string")
    assert len(exact_dedup.drop_copies(nulls).collect()) == 1


# --- chat

MARKS = ["<|im_end|>", "<|im_start|>user\n", "<\\|", "<\\\\|x", "<", "|", "\\", "<|", "%0A%25", "é<|image|>"]


def test_chat_reads_back(spark):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice(MARKS + ["ok", "\n"]) for _ in range(rng.randrange(6)))
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "assistant", "sys\n%0A<|im_end|>", None])
            rows.append((conv, turn, role, rng.choice([text(), None])))
    rows += [(None, 1, "assistant", "n"), (7, 0, "assistant", "tie"), (7, 0, "assistant", "tie")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.read_chat(chat.format_chat(df.withColumn("parts", chat.text_parts("text")))).collect()
    want = {}
    for conv, turn, role, t in rows:
        want.setdefault(conv, []).append((turn, role or "", t or ""))
    assert len(out) == len(want)
    for r in out:
        own = [(s.role, s.text) for s in r.said]
        assert sorted(own) == sorted((a, b) for _, a, b in want[r.conv_id])
        assert r.learned == [t for role, t in own if role == "assistant"]
        assert r.formatted.count("<|im_end|>") == len(own) == r.formatted.count("<|im_start|>")
        for m in r.turns:
            assert r.formatted[m["at"]:].startswith("<|im_start|>")


def test_chat_parts(spark):
    part = "struct<type:string,text:string,ref:string,size:bigint>"
    parts = [("text", "see <|image|>", None, None), ("image", None, "s3://a", 784 * 3 + 1),
             ("audio", None, None, None), (None, "end", "ignored", 5), ("new|kind", None, "r", 9)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (1, 2, "assistant", [])],
                               f"conv_id long, turn long, role string, parts array<{part}>")
    r = chat.format_chat(df).first()
    assert r.formatted == (
        "<|im_start|>user\nsee <\\|image|><|image|><|audio|>end<|new_kind|><|im_end|>\n"
        "<|im_start|>assistant\n<|im_end|>\n" * 1 + "<|im_start|>assistant\n<|im_end|>\n"
    )
    assert [(a.turn, a.type, a.ref, a.tokens) for a in r.attachments] == [
        (0, "image", "s3://a", 4), (0, "audio", None, 1), (0, "new|kind", "r", 9)]
    assert r.attachment_tokens == 14
    assert chat.format_chat(df.limit(0)).collect() == []


# --- decontamination

def leaks(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, item int")
    b = spark.createDataFrame([(i, t, "z") for i, t in enumerate(items)], "item_id long, text string, `key` string")
    return {(r.id, r.item): (r.n_windows, r.exact) for r in decontamination.find_leaks(d, b).collect()}


def test_templates(spark):
    item = "A train leaves Paris at 9 and travels 120 km in 2 hours then how far does it go in 5 hours at that speed if Anna waits 2 hours."
    moved = item.replace("Paris", "Rome").replace("120", "340").replace("Anna", "Bob").replace("2 hours", "7 minutes")
    unfit = item.replace("in 2 hours", "in 3 hours").replace("at 9", "at 2")
    short = "one two three four five six seven"
    docs = ["x y z. " + item.upper(), "so, " + moved, unfit + " tail", "clean text of many words " * 30, None, "",
            short, short + " more", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16", item + item]
    got = leaks(spark, docs, [item, short, None, "", "1 2 3 4 5 6 7 8 9 10 11 12 13 14"])
    # The moved text keeps a run of 13 words as it is, the copies all of it.
    assert got[(1, 0)][1] is True and got[(9, 0)][1] is True
    assert {k for k in got if k[1] == 0} <= {(0, 0), (1, 0), (2, 0), (9, 0)} and {(0, 0), (1, 0), (9, 0)} <= set(got)
    # A short item as written, wherever it stands; numbers only as written.
    assert got[(6, 1)][1] and got[(7, 1)][1]
    assert {k[0] for k in got if k[1] == 4} == {8} and got[(8, 4)][1] is True
    assert not any(k[0] in (3, 4, 5) for k in got)


def test_short_items_and_scripts_without_blanks(spark):
    france, chinese, two = "What is the capital of France?", "\u6cd5\u56fd\u7684\u9996\u90fd\u662f\u54ea\u4e00\u4e2a\u57ce\u5e02\uff1f", "Prime numbers"
    long = "\u5c0f\u660e\u6709\u4e09\u4e2a\u82f9\u679c\u5988\u5988\u53c8\u7ed9\u4e86\u4ed6\u4e94\u4e2a\u8bf7\u95ee\u4ed6\u73b0\u5728\u4e00\u5171\u6709\u51e0\u4e2a\u82f9\u679c"
    docs = [f"They asked: {france.lower()} Nobody knew.", "what is the capital of Spain and why", "the capital of France is what",
            f"\u524d\u9762\u7684\u6587\u5b57{chinese}\u540e\u9762", "\u6cd5\u56fd\u7684\u9996\u90fd\u5f88\u7f8e", two.upper(), f"{two} are odd",
            f"\u9898\u76ee{long}\u3002", long[:10] + "x" + long[17:]]
    got = leaks(spark, docs, [france, chinese, two, long])
    assert set(got) == {(0, 0), (3, 1), (5, 2), (7, 3)} and all(exact for _, exact in got.values())


def test_slots_map_one_to_one(spark):
    """Windows of one item whose values clash are not matched by a document that mixes them up."""
    item = "mix 3 cups of flour with 4 cups of sugar and 3 eggs then bake it well"
    good = item.replace("3", "8").replace("4", "5")
    bad = "mix 8 cups of flour with 8 cups of sugar and 8 eggs then bake it well"
    assert set(leaks(spark, [good, bad], [item])) == {(0, 0)}


def test_windows_of_placeholders(spark):
    """Sums and Title Case are found as they are written, other numbers are not."""
    number = "Compute 12 + 7 - 3 * 48 / 2 + 91 - 14 * 6 + 33 - 5 * 8 + 27 - 9 = 70"
    title = "What Is The Capital City Of The Country Where The Eiffel Tower Was Built In 1889"
    docs = [f"so {number} yes", f"so {title} yes", number.replace("48", "49").replace("33", "34"),
            title.replace("Eiffel", "Other").replace("City", "Town")]
    got = leaks(spark, docs, [number, title])
    assert set(got) == {(0, 0), (1, 1)} and all(exact for _, exact in got.values())


def test_leaks_in_other_case_lines_and_names(spark):
    german = "Wenn der Bauer seine Kuh am Morgen auf die Weide bringt und der Hund die Katze am Abend ins Haus jagt"
    wrapped = "the boat left the harbour with our friend Marta and was seen again in spring"
    opens = "for all of the long hot summer. Weng earns 12 dollars an hour for babysitting"
    moved = "the slow night train that goes on from Rome to the north takes many hours"
    docs = [f"so {german.upper()} yes", f"so {german.lower()} yes", wrapped.replace(" Marta", "\nMarta"),
            opens.replace("Weng", "Bob").replace("12", "30"), moved.replace("Rome", "New York"),
            "clean text of many words " * 30, opens.replace("Weng earns", "Bob spends")]
    got = leaks(spark, docs, [german, wrapped, opens, moved])
    assert set(got) == {(0, 0), (1, 0), (2, 1), (3, 2), (4, 3)}
    assert {k for k, (_, exact) in got.items() if exact} == {(0, 0), (1, 0), (2, 1)}


def test_leaks_of_table_by_brute_force(spark):
    words = lambda t: re.findall(r"[^\W\d_]+|[0-9]+", t.lower())
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = set()
    for d in docs:
        own = " " + " ".join(words(d.text)) + " "
        want |= {(d.doc_id, i.item_id) for i in items if f" {' '.join(words(i.text))} " in own}
    got = {(r.doc_id, r.item_id) for r in queries.op10(spark, SF).collect()}
    assert want and want <= got
    # Anything else shares at least a window of an item.
    for d, i in got - want:
        text = words(next(x.text for x in docs if x.doc_id == d))
        item = words(next(x.text for x in items if x.item_id == i))
        runs = {tuple(text[k : k + 6]) for k in range(len(text))}
        assert any(tuple(item[k : k + 6]) in runs for k in range(len(item) - 5))


def test_leaks_dropped_and_empty(spark):
    item = "here is a fairly long benchmark question with more than thirteen words in it for sure"
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = spark.createDataFrame([(1, f"x {item} y", "k"), (1, f"x {item} y", "k"), (2, None, "k"), (None, "fine", "k")], "doc_id long, text string, key string")
    left = decontamination.drop_leaks(df, b)
    assert left.columns == df.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 2]
    assert decontamination.find_leaks(df.limit(0), b).collect() == []
    assert decontamination.find_leaks(df, b.limit(0)).collect() == []


def test_columns_of_any_name(spark):
    """A given column that is named like the row numbers comes back as it was."""
    item = "here is a fairly long benchmark question with more than thirteen words in it for sure"
    df = spark.createDataFrame([(1, item, -7, "a"), (2, "x", -8, "b"), (2, "x", -8, "b")], "doc_id long, text string, __row long, __ROW_ string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    for out, want in (
        (decontamination.drop_leaks(df, b), [(2, "x", -8, "b")] * 2),
        (exact_dedup.drop_copies(df), [(1, item, -7, "a"), (2, "x", -8, "b")]),
    ):
        assert out.columns == df.columns and sorted(map(tuple, out.collect())) == want
    pages = spark.createDataFrame([(1, "http://a.com/x", 5)], "page_id long, url string, __row long")
    rules = spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")
    r = url_filters.judge_urls(pages, rules).first()
    assert (r["__row"], r.rule, r.verdict) == (5, "com/", "block")


def test_very_long_rows(spark):
    item = "here is a fairly long benchmark question with more than thirteen words in it for sure"
    long = "\u00e9 word " * 60000
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = spark.createDataFrame([(1, long + item), (2, long)], "doc_id long, text string")
    assert [r.doc_id for r in decontamination.drop_leaks(df, b).collect()] == [2]
    pages = spark.createDataFrame([(1, "http://a.com/" + "x" * 300000)], "page_id long, url string")
    rules = spark.createDataFrame([("a.com", "/xxx", "block")], "host string, path string, verdict string")
    assert url_filters.judge_urls(pages, rules).first().verdict == "block"


def test_sha_of_normal_text(spark):
    df = spark.createDataFrame([(1, "ÀB")], "doc_id long, text string")
    assert exact_dedup.exact_groups(df).first().text_sha256 == hashlib.sha256("Àb".encode()).hexdigest()
    assert spark.range(1).select(F.lit(1)).count() == 1
