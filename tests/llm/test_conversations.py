"""Prefix trie and structure repair against plain re-statements."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from parlance.llm import conversation_queries, conversation_repair, prefix_trie, queries

ROWS = "conv_id long, turn long, role string, text string, n int, `key` string"
SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], ROWS)


# --- prefix trie

def words(text):
    for c in BLANK[1:]:
        text = text.replace(c, " ")
    return len([w for w in text.split(" ") if w])


def plain_trie(convs):
    """Nodes of id -> list of (role, text), by trying all prefixes."""
    member = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            member.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for path, own in member.items():
        below = [p for p in member if p[: len(path)] == path]
        inner = {p[:-1] for p in below if p}
        ends = sorted(c for c in own if len(convs[c]) == len(path))
        out.add((
            min(own), len(path), min(member[path[:-1]]) if path else None, len(own),
            sum(len(p) == len(path) + 1 for p in below), sum(p not in inner for p in below),
            sum((len(member[p]) - 1) * words(p[-1][1]) for p in below if p), sha(",".join(map(str, ends))),
        ))
    return out


def listed(trie):
    ends = prefix_trie.digest_lists(trie.ends)
    rows = trie.nodes.join(ends, "path", "left").fillna(conversation_queries.EMPTY_SHA256).collect()
    got = [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
           for r in rows]
    assert len(set(got)) == len(got)
    return set(got)


def some_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 130), -45, -2, 10**12]:
        opening = rng.choice([[("user", "hot first turn"), ("assistant", "and its reply ")], []])
        turns = opening + [(rng.choice(["user", "assistant", None]), rng.choice(["a b", "", None, "c\td e"]))
                           for _ in range(rng.randrange(5))]
        rows += [(c, i if rng.random() < 0.9 else None, *t) for i, t in enumerate(turns)]
    rows += [(500 + i, 0, "user", "the same conversation") for i in range(70)]
    rows += [(7, 3, "user", "tie")] * 3 + [(None, 0, "user", "nobody's")]
    rng.shuffle(rows)
    return rows


def in_order(rows):
    """Conversations in the order the operator states."""
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", sha(f"{len(r[2] or '')}:{r[2] or ''}:{r[3] or ''}"))
    convs = {}
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return convs


@pytest.mark.parametrize("seed,shard", [(1, 1000), (2, 7)])
def test_trie_against_all_prefixes(spark, monkeypatch, seed, shard):
    monkeypatch.setattr(prefix_trie, "SHARD_IDS", shard)
    rows = some_rows(seed)
    convs = prefix_trie.conversations_of(frame(spark, rows).repartition(3))
    assert listed(prefix_trie.prefix_trie(convs)) == plain_trie(in_order(rows))


def test_trie_of_rebuilt(spark):
    rows = some_rows(3)
    own = in_order(rows)
    want = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = own.get(c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20)), [])
        want[c] = first[:h] + turns[h:]
    convs = conversation_queries.rebuilt(prefix_trie.conversations_of(frame(spark, rows)))
    assert listed(prefix_trie.prefix_trie(convs)) == plain_trie(want)
    assert any(not t for t in want.values())


def test_trie_edges(spark):
    given = frame(spark, [(1, 0, "user", "x " * 60000), (2, 0, "user", "x " * 60000)])
    convs = prefix_trie.conversations_of(given)
    assert listed(prefix_trie.prefix_trie(convs)) == plain_trie(in_order([(c, 0, "user", "x " * 60000) for c in (1, 2)]))
    assert prefix_trie.prefix_trie(convs.limit(0)).nodes.collect() == []
    assert prefix_trie.conversations_of(given.limit(0)).collect() == []
    bare = spark.createDataFrame([(5, None), (None, None)], "conv_id long, turns array<struct<key:binary,tokens:bigint>>")
    assert listed(prefix_trie.prefix_trie(bare)) == plain_trie({5: []})
    deep = [(9, i, "user", str(i)) for i in range(3000)]
    trie = prefix_trie.prefix_trie(prefix_trie.conversations_of(frame(spark, deep)))
    assert trie.nodes.agg(F.max("depth"), F.sum("n_leaves")).first() == (3000, 3001)


# --- repair

def all_repairs(rows, cap):
    """Every (cost, audit, turns) up to a cost, by trying all edits; rows are (role, text, fault)."""
    out = []

    def go(i, cost, audit, turns):
        if cost > cap:
            return
        letters = "".join(r[:1] if r[:1] in "sua" else "-" for r, _ in turns)
        body = letters[1:] if letters[:1] == "s" else letters
        if any(c != "ua"[k % 2] for k, c in enumerate(body)):
            return
        if i == len(rows):
            if not letters or (body and len(body) % 2 == 0):
                out.append((cost, audit, turns))
        else:
            role, text, fault = rows[i]
            go(i + 1, cost + 4, audit + "D", turns)
            if fault not in ("b", "d"):
                more = 3 if fault == "t" else 0
                if role:
                    go(i + 1, cost + more, audit + "K", [*turns, (role, text)])
                for to in ("user", "assistant"):
                    go(i + 1, cost + 3 + more, audit + "R", [*turns, (to, text)])
        for to in ("user", "assistant"):
            go(i, cost + 3, audit + "I", [*turns, (to, "")])

    go(0, 0, "", [])
    return out


def plain_repair(rows):
    """What the contract says of rows (turn, role, text) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, told = set(), []
    for _, role, text in rows:
        last = text.rstrip(BLANK)[-1:]
        fault = "b" if not last else "d" if (role, text) in seen else "." if last in ".!?" else "t"
        seen.add((role, text))
        told.append((role, text, fault))
    turns = [t for t, *_ in rows if t is not None]
    heads = [role[:1] for role, *_ in told]
    cost, audit, best = min(all_repairs(told, 4 * len(rows)), key=lambda x: x[:2])
    faults = [f for *_, f in told]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        faults.count("b"), faults.count("d"), faults.count("t"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:])), cost, audit,
        "\n".join(f"{role}:{text}" for role, text in best),
    )


def repaired(df):
    return {
        r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit,
                    "\n".join(f"{t.role}:{t.text}" for t in r.repaired))
        for r in conversation_repair.repair_conversations(df).collect()
    }


def test_repair_against_all_edits(spark):
    rng = random.Random(4)
    rows = []
    for c in range(150):
        for i in range(rng.randrange(1, 5)):
            role = rng.choice(["user", "assistant", "assistant", "system", "tool", "", "upper"])
            text = rng.choice(["done.", "what?", "cut off", " \n", "ok!\t", "end ", "é."])
            rows.append((c, rng.choice([i, i, i + 2, None]), role, text))
    rows += [(None, 1, None, None), (None, 0, "user", "hi.")]
    want = {}
    for c, turn, role, text in rows:
        want.setdefault(c, []).append((turn, role or "", text or ""))
    got = repaired(frame(spark, rows).repartition(3))
    assert got == {c: plain_repair(own) for c, own in want.items()}


def test_damage_and_repair_of_table(spark):
    given = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    own = {}
    for r in given:
        role, text = (" " if v is None else v for v in (r.role, r.text))
        turn = " " if r.turn is None else r.turn
        kind = zlib.crc32(f"{r.conv_id}:{turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if kind == 4:
            role = "user"
        own.setdefault(r.conv_id, []).extend([(r.turn, role, text)] * (2 if kind == 3 else kind != 0))
    got = queries.QUERIES["op13_conversation_repair"](spark, SF).collect()
    assert {r.conv_id for r in got} == set(own) and len(got) == len(own)
    for r in got:
        want = plain_repair(own[r.conv_id]) if own[r.conv_id] else (0, 0, 0, 0, 0, 0, "", "")
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == (
            *want[:7], sha(want[7]))


def test_repair_edges(spark):
    long = "word " * 50000
    got = repaired(frame(spark, [(1, 0, "user", long), (1, 1, "assistant", long + ".")]))
    assert got[1][:7] == (0, 0, 0, 1, 0, 3, "KK")
    assert repaired(frame(spark, [(2, None, "user", "a."), (2, None, "user", "a.")]))[2][:7] == (0, 0, 1, 0, 1, 7, "KDI")
    assert conversation_repair.repair_conversations(frame(spark, [(1, 0, "u", "t")]).limit(0)).collect() == []
    assert conversation_repair.plan("u.a." * 500)[0] == 0


def test_agenda_with_shared_antecedents():
    add = lambda *v: (sum(x[0] for x in v), None)
    rules = [("c", ("a", "b"), add), ("c", ("b",), lambda v: (v[0] + 9, None)), ("goal", ("c", "a"), add), ("x", ("y",), add)]
    assert conversation_repair.lightest_derivation({"a": (1, None), "b": (2, None)}, rules, "goal")[0] == 4
    assert conversation_repair.lightest_derivation({"a": (1, None)}, rules, "x") is None
