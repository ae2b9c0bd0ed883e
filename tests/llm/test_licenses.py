"""Licence scans against plain searches and a parser by recursive descent."""

import random
import re

import pytest

from parlance.llm import licenses, queries

SF = "/root/testdata/sf0.001"


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))


def plain_places(text, phrases):
    own = plain_words(text)
    return [
        (label, i, len(p.split())) for p, label in phrases for i in range(len(own))
        if own[i : i + len(p.split())] == p.split()
    ]


def descend(tokens):
    """Restriction of an expression, ``with`` before ``and`` before ``or``; None if it is none."""

    def level(ops):
        if not ops:
            return single()
        value = level(ops[1:])
        while tokens and tokens[0] == ops[0]:
            tokens.pop(0)
            right = level(ops[1:])
            value = min(value, right) if ops[0] == "or" else max(value, right)
        return value

    def single():
        head = tokens.pop(0) if tokens else ")"
        if head == "(":
            value = level(["or", "and"])
            if not tokens or tokens.pop(0) != ")":
                raise ValueError
        elif head in licenses.BINDS or head == ")":
            raise ValueError
        else:
            value = licenses.RESTRICTION.get(licenses.family(head), licenses.UNKNOWN)
        while tokens and tokens[0] == "with":
            tokens.pop(0)
            if not tokens or tokens.pop(0) in ("(", ")", *licenses.BINDS):
                raise ValueError
            value = min(value, licenses.EASED)
        return value

    value = level(["or", "and"])
    if tokens:
        raise ValueError
    return value


NAMES = ["mit", "gpl-3.0-only", "lgpl-2.1+", "apache-2.0", "odd-1", "cc-by-nc-4.0", "agpl-3.0"]


def made(rng, depth=0):
    roll = rng.random()
    if roll < 0.4 or depth > 4:
        return rng.choice(NAMES)
    if roll < 0.55:
        return f"({made(rng, depth + 1)})"
    if roll < 0.65:
        return f"{rng.choice(NAMES)} with classpath-exception-2.0"
    return f"{made(rng, depth + 1)} {rng.choice(['or', 'and'])} {made(rng, depth + 1)}"


def test_expressions_by_descent():
    rng = random.Random(6)
    for _ in range(500):
        line = made(rng)
        read, labels, value = licenses.read_expression(line)
        tokens = re.findall(r"[()]|[^\s()]+", line)
        assert read.split() == tokens and value == descend(list(tokens)), line
        assert labels == [licenses.family(t) for i, t in enumerate(tokens)
                          if t not in ("(", ")", "or", "and", "with") and tokens[i - 1 : i] != ["with"]]


@pytest.mark.parametrize("line", ["", "   ", "or mit", "mit or", "(mit", "()", "mit with", "mit with (x)", "mit and )"])
def test_no_expression(line):
    with pytest.raises(ValueError):
        descend(re.findall(r"[()]|[^\s()]+", line))
    assert licenses.read_expression(line) is None and licenses.read_expression("*/ mit") is None


def test_expression_ends_where_it_must():
    assert licenses.read_expression("mit */ gpl-3.0")[0] == "mit"
    assert licenses.read_expression("mit) or gpl-3.0")[0] == "mit"
    assert licenses.read_expression("(mit or isc) text")[0] == "( mit or isc )"
    assert licenses.family("gpl-2.0+") == "gpl" and licenses.family("cc-by-nc-sa-4.0") == "cc-by-nc-sa"
    assert licenses.family("mitx") == "mitx"


TEXTS = [
    None, "", " \n", "MIT License", "the mit-license; MIT  LICENSE mit license", "mit licenses", "xmit license",
    "GNU General Public\nLicense, CC BY-NC 4.0", "gnu general public gnu general public license license",
    "é mit license ", "mit license x", "0mit license",
    "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 */\ncc by",
    "SPDX-License-Identifier: nothing(", "a " * 60000 + "apache license" + " b" * 60000, "mit license " * 3000,
    "\x00mit\x00license\x7f", "ＭＩＴ License",
]


def scan(spark, texts):
    data = [(i, t, "clash", 0.5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "doc_id long, text string, labels string, score double")
    return {r.doc_id: r for r in licenses.scan_licenses(df.repartition(3)).collect()}


def check(row, text):
    base, more = plain_places(text, licenses.BASE), plain_places(text, licenses.NOTICES)
    starts = [i for _, i, _ in base]
    assert row.n_words == len(plain_words(text)) and row.n_base == len(base)
    assert (row.first_word, row.last_word) == (min(starts, default=None), max(starts, default=None))
    assert row.base_labels == ",".join(sorted({label for label, *_ in base}))
    assert set(row.base_labels.split(",")) <= set(row.labels.split(",")) | {""}
    if hasattr(row, "notices"):
        assert sorted((n.label, n.word, n.words) for n in row.notices) == sorted(base + more)
        noticed = [licenses.RESTRICTION[label] for label, *_ in base + more]
        assert row.score == max(noticed + [t.restriction for t in row.tags], default=0.0)


def test_scan_against_plain_search(spark):
    rng = random.Random(7)
    pieces = [w for p, _ in licenses.BASE + licenses.NOTICES for w in p.split()] + ["x", "\n", "É"]
    texts = TEXTS + [" ".join(rng.choice(pieces) for _ in range(40)) for _ in range(200)]
    got = scan(spark, texts)
    for i, t in enumerate(texts):
        check(got[i], t or "")
    tag = got[12]
    assert [(t.expression, t.at, t.restriction) for t in tag.tags] == [("( mit or gpl-2.0-only ) and apache-2.0", 3, 0.2)]
    assert tag.labels == "apache,cc-by,gpl,mit" and tag.base_labels == "cc-by"
    assert [(t.expression, t.at, t.restriction) for t in got[13].tags] == [("nothing", 0, 0.5)]


def test_scan_of_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op11_license_scans"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        check(r, texts[r.doc_id] or "")


def test_scan_edges(spark):
    df = spark.createDataFrame([(None, "mit license"), (1, "mit license"), (1, "mit license")], "doc_id long, text string")
    got = licenses.scan_licenses(df).collect()
    assert sorted((r.doc_id or 0, r.labels, r.score) for r in got) == [(0, "mit", 0.2), (1, "mit", 0.2), (1, "mit", 0.2)]
    assert licenses.scan_licenses(df.limit(0)).collect() == []
    bare = licenses.scan_licenses(df, base=[], notices=[], tags=[]).collect()
    assert {(r.n_words, r.n_base, r.labels, r.score) for r in bare} == {(2, 0, "", 0.0)}
