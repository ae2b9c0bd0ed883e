"""Trie of conversation prefixes by vertical bitmaps.

Conversations are dealt to shards by ranges of their ids. A shard indexes (position, turn)
to a bitset of its conversations; depth first, a node's bitset met with the postings of the
next position gives its children, a popcount their members, and the bitset of conversations
of that length the list that ends there. The nodes of all shards then meet by the digest of
their path, so a prefix that many conversations share is one row per shard, never a list.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.session import settle

# Ids a shard spans, and so the most conversations it holds.
SHARD_IDS = 1000
ROOT = b"\0" * 16

PART = (
    "shard bigint, path binary, parent binary, depth bigint, low bigint, n bigint, reach bigint, "
    "tokens bigint, first_end bigint, ends string"
)
SUMS = "path binary, parent_conv bigint, words bigint, leaves bigint"


class Trie(NamedTuple):
    """``nodes``: one row per distinct prefix; ``ends``: where conversations end.

    ``nodes`` has ``path`` and ``parent`` (16-byte digests of the prefixes, root: null parent),
    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves`` and ``saved_tokens``. ``ends`` has, per node and shard in which conversations
    end at it, ``path``, ``first_end`` (their smallest id) and ``ends`` (their ids, ascending,
    joined by commas); by ``first_end`` the lists of a node follow one another.
    """

    nodes: DataFrame
    ends: DataFrame


def turn_of(role: Column, text: Column) -> Column:
    """A turn as the trie sees it: the digest of role and text, and the words of the text.

    Null counts as empty. Words are maximal runs without ASCII white space.
    """
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    whole = F.concat_ws(":", F.length(role).cast("string"), role, text)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return F.struct(F.unhex(F.sha2(whole, 256)).alias("key"), words.alias("tokens"))


def conversations_of(
    rows: DataFrame,
    conv: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation: ``conv_id`` and its ``turns`` in order, null order first.

    Turns of equal order follow by role, then by the digest of the turn, so the result never
    depends on how rows are dealt. Rows without a conversation id belong to no conversation
    and are left out. Texts become digests before anything moves; the digests of one
    conversation are the most a row holds. Extra columns are ignored, an empty table gives
    an empty table.
    """
    turn = F.struct(
        F.col(order).alias("order"), F.coalesce(role, F.lit("")).alias("role"),
        turn_of(F.col(role), F.col(text)).alias("turn"),
    )
    read = rows.filter(F.col(conv).isNotNull()).select(F.col(conv).alias("conv_id"), turn.alias("t"))
    gathered = read.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return gathered.select("conv_id", F.col("t.turn").alias("turns"))


def index_shard(convs: list[int], keys: list, tokens: list) -> list[tuple]:
    """Nodes of one shard's conversations, given in ascending order of id.

    Per node: path, parent path, depth, smallest member, members, words of all members'
    turns from this depth on, words of its last text, members that end here.
    """
    postings: dict[tuple[int, bytes], int] = {}
    length: dict[int, int] = {}
    said: dict[bytes, int] = {}
    for i, own in enumerate(keys):
        bit = 1 << i
        length[len(own)] = length.get(len(own), 0) | bit
        for place, (key, words) in enumerate(zip(own, tokens[i])):
            postings[place, key] = postings.get((place, key), 0) | bit
            said[key] = int(words)
    nodes: list[tuple] = []
    reach: list[int] = []
    above: list[int] = []
    todo = [((1 << len(convs)) - 1, 0, ROOT, None, 0, -1)]
    while todo:
        members, depth, path, parent, words, up = todo.pop()
        ending = members & length.get(depth, 0)
        rest, me = members ^ ending, len(nodes)
        while rest:
            key = keys[lowest(rest)][depth]
            child = rest & postings[depth, key]
            rest ^= child
            below = hashlib.blake2b(path + key, digest_size=16).digest()
            todo.append((child, depth + 1, below, path, said[key], me))
        n = members.bit_count()
        nodes.append((path, parent, depth, convs[lowest(members)], n, words, ending))
        reach.append(n * words)
        above.append(up)
    for i in range(len(nodes) - 1, 0, -1):
        reach[above[i]] += reach[i]
    return [
        (path, parent, depth, low, n, reach[i], words, [convs[j] for j in bits(ending)])
        for i, (path, parent, depth, low, n, words, ending) in enumerate(nodes)
    ]


def lowest(bitset: int) -> int:
    return (bitset & -bitset).bit_length() - 1


def bits(bitset: int) -> Iterator[int]:
    while bitset:
        yield lowest(bitset)
        bitset &= bitset - 1


def shard_nodes(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("conv", kind="stable")
    found = index_shard(rows["conv"].tolist(), rows["keys"].tolist(), rows["tokens"].tolist())
    path, parent, depth, low, n, reach, words, ends = zip(*found)
    return pd.DataFrame({
        "shard": rows["shard"].iloc[0], "path": path, "parent": parent, "depth": depth, "low": low,
        "n": n, "reach": reach, "tokens": words,
        "first_end": pd.array([e[0] if e else None for e in ends], "Int64"),
        "ends": [",".join(map(str, e)) for e in ends],
    })


def shard_sums(rows: pd.DataFrame) -> pd.DataFrame:
    """Words and leaves below each node, of the nodes whose smallest member is in this shard."""
    rows = rows.sort_values("depth", ascending=False, kind="stable")
    at = {path: i for i, path in enumerate(rows["path"])}
    own = (rows["low"] == rows["conv_id"]).to_numpy()
    words = (rows["tokens"].to_numpy() * own).tolist()
    leaves = ((rows["n_children"] == 0).to_numpy() & own).astype("int64").tolist()
    smallest, top = rows["conv_id"].tolist(), [None] * len(rows)
    for i, parent in enumerate(rows["parent"]):
        if parent is not None:
            up = at[parent]
            words[up] += words[i]
            leaves[up] += leaves[i]
            top[i] = smallest[up]
    return pd.DataFrame({
        "path": rows["path"].to_numpy(), "parent_conv": pd.array(top, "Int64"), "words": words, "leaves": leaves,
    })


def prefix_trie(convs: DataFrame, conv: str = "conv_id", turns: str = "turns") -> Trie:
    """Trie of all prefixes of conversations, from the prefix without turns on.

    ``convs`` has one row per conversation: a whole-number id and an array of turns
    ``struct<key: binary, tokens: bigint>`` as ``turn_of`` makes them, empty or null for a
    conversation without turns. A node's ``saved_tokens`` sums over its subtree the words of
    each node's last text times its members but one: what need not be read again if shared
    prefixes are.

    A shard is a range of ``SHARD_IDS`` ids. Shards give one row per node they hold, and these
    meet by path: members and words by sums, smallest members by minima. Each node then counts
    for the words and leaves below its ancestors in the one shard that holds its smallest
    member, which holds its ancestors too. A turn or conversation that most rows share is one
    row per shard in each of these steps. Nodes are told apart by 128 bits of a digest of role
    and text of all turns.

    Rows without an id are left out; rows that repeat an id are members of their own. Extra
    columns are ignored, an empty table has no nodes, not even the root. Results of steps that
    are read twice are written to the shared folder.
    """
    rows = convs.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"),
        F.coalesce(F.col(turns)["key"], F.array().cast("array<binary>")).alias("keys"),
        F.coalesce(F.col(turns)["tokens"], F.array().cast("array<bigint>")).alias("tokens"),
    ).withColumn("shard", F.expr(f"conv div {SHARD_IDS}"))
    parts = settle(rows.groupBy("shard").applyInPandas(shard_nodes, PART), "trie-parts")
    met = parts.groupBy("path").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"),
        F.min("low").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("reach").alias("reach"),
    )
    met = settle(met, "trie-nodes")
    children = met.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("path")).agg(
        F.count("*").alias("n_children")
    )
    nodes = met.join(children, "path", "left").fillna(0, ["n_children"])
    held = parts.select("shard", "path", "parent", "depth", "low", "tokens").join(
        nodes.select("path", "conv_id", "n_children"), "path"
    )
    sums = held.groupBy("shard").applyInPandas(shard_sums, SUMS).groupBy("path").agg(
        F.first("parent_conv").alias("parent_conv_id"), F.sum("words").alias("words"),
        F.sum("leaves").alias("n_leaves"),
    )
    nodes = nodes.join(sums, "path").select(
        "path", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("reach") - F.col("words")).alias("saved_tokens"),
    )
    return Trie(nodes, parts.filter("ends <> ''").select("path", "first_end", "ends"))


def digest_lists(ends: DataFrame) -> DataFrame:
    """``path`` and ``ends_sha256``, the digest of all ids that end there, ascending.

    The lists of a node are read one after another in order of their first id, so a node at
    which most conversations end takes no more memory than any other.
    """
    placed = ends.repartition("path").sortWithinPartitions("path", "first_end")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, state = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for own, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own == path:
                    state.update(b"," + listed.encode())
                    continue
                if path is not None:
                    done.append((path, state.hexdigest()))
                path, state = own, hashlib.sha256(listed.encode())
            yield digests(done)
        if path is not None:
            yield digests([(path, state.hexdigest())])

    return placed.select("path", "ends").mapInArrow(digest, "path binary, ends_sha256 string")


def digests(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], t) for i, t in ((0, pa.binary()), (1, pa.string()))]
    return pa.RecordBatch.from_arrays(columns, ["path", "ends_sha256"])
