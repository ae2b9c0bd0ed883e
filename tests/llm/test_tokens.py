"""Token counts and packing against the library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from parlance.llm import packing, queries, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n\t ", "a", "Don't STOP 12,5 it's", "ÉÇ élan ΣΟΦΟΣ İstanbul ǆ",
    "x<|endoftext|>y <|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", "a\x1cb\x1d c\x85d e　f",
    "é ́x á̧", "日本語 のテキスト 한국어", "!!!??? ... #$%", "z" * 3000, "ab " * 5000,
    "𝒳 😀😀 👩‍👩‍👧", "\u0000 ﻿ x​", "a'b'c'll 'LL 'S",
]


def ids(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


def rows(spark, texts):
    data = [(i, t, "clash", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, n_tokens string, `start` long")


def test_counts_match_library(spark):
    random.seed(1)
    made = ["".join(random.choice("abtheinr' .,!é12\n") for _ in range(random.randrange(60)))
            for _ in range(300)]
    texts = ODD + made
    got = {r.doc_id: r for r in token_counts.count_tokens(rows(spark, texts), PATH).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_tokens, got[i].n_bytes) == (len(ids(t)), len((t or "").encode())), repr(t)


def test_counts_of_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op9(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(ids(texts[r.doc_id]))
        assert (r.n_tokens, r.over_limit) == (n, n > 2048)


def test_equal_ranks_merge_leftmost():
    ranks = {("a", "a"): 0, ("aa", "a"): 1}
    assert token_counts.merged_length(list("aaaaa"), ranks) == 2
    assert token_counts.merged_length(["a"], ranks) == 1
    assert token_counts.merged_length([], ranks) == 0


def check_pieces(pieces, texts, capacity):
    """Whole documents, gapless sequences, right digests; gives the tokens per sequence."""
    want = {i: ids(t) + [2] for i, t in texts.items()}
    seen, filled = {i: 0 for i in want}, {}
    for p in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        own = want[p.doc_id]
        assert p.start == seen[p.doc_id] and p.length > 0 and p.doc_tokens == len(own)
        part = np.array(own[p.start : p.start + p.length], "<u4")
        assert p.ids_crc32 == zlib.crc32(part.tobytes())
        seen[p.doc_id] += p.length
    assert seen == {i: len(w) for i, w in want.items()}
    for p in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert p.offset == filled.get(p.sequence_id, 0)
        filled[p.sequence_id] = p.offset + p.length
    assert all(n <= capacity and n & (n - 1) == 0 for n in filled.values())
    return filled


def test_packing_of_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    filled = check_pieces(queries.op8(spark, SF).collect(), texts, 4096)
    assert sum(n == 4096 for n in filled.values()) >= len(filled) - 12 * 8


def test_packing_odd_rows(spark):
    texts = dict(enumerate(ODD))
    made = packing.pack(rows(spark, ODD).repartition(3), PATH, capacity=64, group_tokens=128)
    pieces = made.collect()
    check_pieces(pieces, texts, 64)
    assert all(len(p.ids) == p.length for p in pieces)


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    got = packing.pack(df.coalesce(1), PATH).collect()
    assert sum(r.length for r in got) == 3 + 3 + 2
    assert {r.doc_id for r in got} == {1, None}
    counted = token_counts.count_tokens(df, PATH).collect()
    assert sorted(r.n_tokens for r in counted) == [1, 2, 2]


def test_plain_words_are_the_librarys():
    random.seed(2)
    plain = packing.PlainWords(LIB)
    assert plain.usable
    letters = "abzABZéÉßÿÀøØµªºþÐñ" + "ı" + "İΣσς" + "한ㄱ" + "Å" + "e\u0301" + "'.,;:!?-1 "
    seen = 0
    for _ in range(4000):
        chunk = "".join(random.choice(letters) for _ in range(random.randrange(1, 7))).strip()
        if chunk:
            own = plain.ids(chunk)
            seen += own is not None
            assert own is None or own == ids(chunk), repr(chunk)
    assert seen > 300
    for path in ("byte_bpe_50k.json",):
        other = Tokenizer.from_file(public_tokenizers.path(path))
        assert not packing.PlainWords(other).usable


def test_empty_table(spark):
    empty = rows(spark, ODD).limit(0)
    assert packing.pack(empty, PATH).collect() == []
    assert token_counts.count_tokens(empty, PATH).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_groups_fill_every_sequence(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 300, 40)
    room = packing.powers(int(sizes.sum()), 64)
    held = np.zeros(len(room), np.int64)
    for _, _, n, seq, offset in packing.pack_group(sizes, room):
        assert offset == held[seq]
        held[seq] += n
    assert (held == room).all()
    assert packing.powers(0, 64).size == 0


def test_costs_are_even():
    rng = np.random.default_rng(3)
    sizes = rng.integers(10, 900, 3000)
    sizes[-1] += -sizes.sum() % 4096
    room = packing.powers(int(sizes.sum()), 4096)
    cost = np.zeros(len(room))
    for _, _, n, seq, _ in packing.pack_group(sizes, room):
        cost[seq] += packing.attention_cost(n)
    assert cost.max() < 1.35 * cost.mean()
