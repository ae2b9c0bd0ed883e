"""Similarity join of documents by their sets of word n-grams, with a token-group matrix.

Similar documents are put into groups, a group keeps the union of its members' tokens, and
a document is compared with a group's members only if it shares enough tokens with the
union to be similar to any of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import repeats
from parlance.llm.common import (
    ROW, Growing, keeps_columns, mix64, numbered, parts_for, release, spread_index, text_bytes, window_hash,
)
from parlance.llm.components import components
from parlance.llm.words import ChunkTable, text_slices
from parlance.session import settle

WORDS = 5
# Share of all hashes for which it is found out whether they occur in several documents.
PROBED = 0.36
PROBE_BELOW = np.uint64(int(PROBED * 2**64))
# Members of a group, and bytes of their sets, where a group of similar documents has to be
# cut; on average, as the cut is by hash.
GROUP, GROUP_BYTES = 1024, 16 << 20
# A token found oftener than this in a batch of sets, or in more records than CROWD, comes
# last in the order of tokens.
MOST, CROWD = 4, 64
# Smallest tokens under different orders; each puts similar sets into groups of its own.
KEYS = ("low", "low2", "low3")
# Rows whose tokens are asked about together.
ASKED_ROWS = 2500
# Columns of a membership matrix held at once.
BLOCK = 1 << 13


@dataclass(frozen=True)
class Threshold:
    """Similar: ``100 * intersection >= percent * union``."""

    percent: int = 75

    def least(self, n):
        """Tokens a set of ``n`` shares at least with any similar set."""
        return -(-self.percent * n // 100)

    def prefix(self, n):
        """Of two similar sets, the first so many tokens of each have one in common."""
        return n - self.least(n) + 1

    def holds(self, both, n, m):
        return 100 * both >= self.percent * (n + m - both)


class Sets:
    """Sorted distinct n-gram hashes of texts, given as bytes."""

    def __init__(self, words: int = WORDS) -> None:
        self.words = words
        self.table = ChunkTable(self._new, lambda t: t.lower().split(), limit=150_000)

    def _new(self):
        self.hashes = Growing(np.uint64)
        return self._learn

    def _learn(self, fresh: list[bytes]) -> None:
        digests = b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in fresh)
        self.hashes.add(np.frombuffer(digests, np.uint64))

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        codes, counts = self.table.encode(texts)
        seq = self.hashes.view()[codes]
        grams = window_hash(seq, self.words)
        heads = np.cumsum(counts) - counts
        # A shorter text is one n-gram, however few words it has.
        short = {n: window_hash(seq, n) for n in set(counts.tolist()) if 0 < n < self.words}
        out = []
        for at, n in zip(heads.tolist(), counts.tolist()):
            if n >= self.words:
                out.append(np.unique(grams[at : at + n - self.words + 1]))
            else:
                out.append(short[n][at : at + 1] if n else np.zeros(0, np.uint64))
        return out


def _read(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return rows.select(ROW, F.col(id_col).alias("id"), body.alias("body"))


def _summaries(read: DataFrame, size: int, words: int) -> DataFrame:
    """Per row: set size, a 128-bit name of the set, how many of its tokens were probed
    and how many of those occur in another row as well."""
    buckets = parts_for(read, size // 2)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = Sets(words)
        for batch in (b.iloc[i : i + ASKED_ROWS] for b in batches for i in range(0, len(b), ASKED_ROWS)):
            texts, rows = batch["body"].tolist(), batch[ROW].to_numpy(np.int64)
            held = []
            for a, b in text_slices(texts):
                held += sets(texts[a:b])
            n = np.fromiter(map(len, held), np.int64, len(held))
            probes = [s[: np.searchsorted(s, PROBE_BELOW)] for s in held]
            probed = np.fromiter(map(len, probes), np.int64, len(held))
            keys = np.concatenate([*probes, np.zeros(0, np.uint64)])
            owner = np.repeat(np.arange(len(held)), probed)
            known, asked = repeats.questions(
                keys, rows[owner], np.zeros(len(keys), np.int32), buckets
            )
            names = np.frombuffer(
                b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in held), np.int64
            ).reshape(-1, 2)
            # What is known of the rows travels with the questions, so texts are read once.
            yield asked.assign(own=None)
            own = np.column_stack([
                rows, n, probed, np.bincount(owner[known], minlength=len(held)), names
            ]).astype(np.int64)
            part = repeats.part_of(rows, buckets)
            order = np.argsort(part, kind="stable")
            first, size = repeats.runs(part[order])
            yield pd.DataFrame(
                [(int(part[order[a]]), b"", b"", b"", own[order[a : a + k]].tobytes())
                 for a, k in zip(first, size)],
                columns=["bucket", "keys", "refs", "places", "own"],
            )
        release()

    def answer(packed: pd.DataFrame) -> pd.DataFrame:
        refs, _, _ = repeats.answers(packed)
        first, n = repeats.runs(refs)
        told = repeats.grouped(refs[first], n, np.zeros(len(n), np.int64), buckets)
        own = b"".join(x for x in packed["own"] if x)
        mine = pd.DataFrame([(int(packed["bucket"].iat[0]), own)], columns=["part", "own"])
        return pd.concat([told, mine])[["part", "refs", "x", "own"]]

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        own, refs, n = (
            np.frombuffer(b"".join(x for x in group[c] if isinstance(x, bytes)), np.int64)
            for c in ("own", "refs", "x")
        )
        own = own.reshape(-1, 6).copy()
        own = own[np.argsort(own[:, 0], kind="stable")]
        np.add.at(own[:, 3], np.searchsorted(own[:, 0], refs), n)
        return pd.DataFrame(own, columns=[ROW, "n", "probed", "again", "name_a", "name_b"])

    asked = read.mapInPandas(ask, repeats.PACKED + ", own binary")
    told = asked.groupBy("bucket").applyInPandas(answer, "part int, refs binary, x binary, own binary")
    names = [ROW, "n", "probed", "again", "name_a", "name_b"]
    return told.groupBy("part").applyInPandas(gather, ", ".join(f"{c} long" for c in names))


def _sets(read: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """Sets of the chosen rows, packed, with their size and smallest token."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = Sets(words)
        for batch in batches:
            texts = batch["body"].tolist()
            for a, b in text_slices(texts):
                held = sets(texts[a:b])
                yield pd.DataFrame({
                    ROW: batch[ROW].iloc[a:b].to_numpy(),
                    **{k: [_least(s, i) for s in held] for i, k in enumerate(KEYS)},
                    "tokens": [s.tobytes() for s in held],
                })
        release()

    chosen = read.select(ROW, "body").join(rows.select(ROW).hint("merge"), ROW)
    return chosen.mapInPandas(make, f"{ROW} long, {', '.join(f'{k} long' for k in KEYS)}, tokens binary")


def _least(tokens: np.ndarray, order: int) -> int:
    """Smallest token under one of several orders; similar sets mostly share it."""
    if order == 0:
        return int(tokens[:1].view(np.int64)[0])
    return int(mix64(tokens ^ np.uint64(order)).min().astype(np.int64))


def _carry(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows with their tokens. Sets are many and large: they are met by sorting, at any size."""
    return rows.join(sets.select(ROW, "tokens").hint("merge"), ROW)


def _unpack(blobs) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in blobs]


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all sets of one group, from a membership matrix cut in blocks."""
    sizes = [len(s) for s in sets]
    tokens = np.concatenate(sets)
    member = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    first, n = repeats.runs(tokens[order])
    column = np.empty(len(tokens), np.int64)
    column[order] = np.repeat(np.arange(len(first)), n)
    shared = n[column] > 1
    column, member = column[shared], member[shared]
    _, column = np.unique(column, return_inverse=True)
    both = np.zeros((len(sets), len(sets)), np.float32)
    by = np.argsort(column, kind="stable")
    column, member = column[by], member[by]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, BLOCK):
        lo, hi = np.searchsorted(column, [a, a + BLOCK])
        held = np.zeros((len(sets), BLOCK), np.float32)
        held[member[lo:hi], column[lo:hi] - a] = 1
        both += held @ held.T
    both = both.astype(np.int64)
    np.fill_diagonal(both, sizes)
    return both


def reach(linked: np.ndarray) -> np.ndarray:
    """Smallest index each index of a symmetric matrix is connected with."""
    label = np.arange(len(linked))
    while True:
        low = np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked))
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _inside(grouped: DataFrame, limit: Threshold) -> DataFrame:
    """Per member of a group: the smallest member it is connected with, and its links."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(ROW)
        sets, rows = _unpack(group["tokens"]), group[ROW].to_numpy()
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        linked = limit.holds(overlaps(sets), n[:, None], n[None, :])
        out = pd.DataFrame({
            ROW: rows, "root": rows[reach(linked)], "links": linked.sum(axis=1).astype(np.int64) - 1
        })
        if len(out) > GROUP // 8:
            del sets, linked
            release()
        return out

    return grouped.groupBy("place").applyInPandas(compare, f"{ROW} long, root long, links long")


def _cut(rows: DataFrame, key: str) -> DataFrame:
    """A group id per row: rows of one key share a group of bounded size, or are dealt over
    several by hash. ``size`` is the number of rows of the key, ``parts`` of its groups."""
    sizes = rows.groupBy(key).agg(
        F.count("*").alias("size"),
        F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("bytes") / GROUP_BYTES)).cast("long").alias("parts"),
    )
    part = F.pmod(F.xxhash64(ROW), F.col("parts"))
    return rows.join(sizes, key).withColumn("place", F.xxhash64(key, part))


def _merge(members: DataFrame, key: str, sets: DataFrame, limit: Threshold) -> DataFrame:
    """Members with the labels of components that meet under a key and have a link there.

    The best-linked row of each component speaks for it, so a group of copies of any size
    brings a few rows; groups that were compared whole are not compared again.
    """
    rows = members.filter("parts > 1") if key == KEYS[0] else members
    voices = (
        rows.groupBy(key, "label").agg(F.max_by(F.struct(ROW, "bytes"), F.struct("links", ROW)).alias("v"))
        .select(key, "label", f"v.{ROW}", "v.bytes")
    )
    cut = settle(_cut(voices, key).filter("size > 1").select(ROW, "label", "place"), "voices")
    found = _inside(_carry(cut.select(ROW, "place"), sets), limit).filter(F.col(ROW) != F.col("root"))
    names = cut.select(F.col(ROW).alias("r"), F.col("label").alias("t"))
    links = (
        found.join(names, F.col(ROW) == F.col("r")).select(F.col("t").alias("a"), "root")
        .join(names, F.col("root") == F.col("r")).select("a", F.col("t").alias("b"))
    )
    merged = components(links)
    named = members.join(merged, members["label"] == merged["node"], "left")
    return settle(
        named.withColumn("label", F.coalesce("component", "label")).drop("node", "component"), "members"
    )


def _candidates(firsts: DataFrame, limit: Threshold) -> DataFrame:
    """Rows and the groups of other components a row could have a link into.

    A group holds members of one component. Of two components with a token in common the
    smaller one asks, so what is asked of a component grows with the rows outside it and
    with its groups, not with its rows. A group whose members with that token are all too
    small or too large for the row, or have too little in common with others from that token
    on, is not asked.
    """
    mixed = firsts.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"))
    held = firsts.join(mixed.filter("x <> y").select("token"), "token")
    matrix = held.groupBy("token", "place").agg(
        F.first("label").alias("other"), F.first("size").alias("others"),
        F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("onward"),
    )
    asks = (F.col("size") < F.col("others")) | (
        (F.col("size") == F.col("others")) & (F.col("label") < F.col("other"))
    )
    # What the row and a member have in common is at most what either has from the first
    # common token on, and at least what the threshold asks of two sets of their sizes.
    fits = (
        (100 * F.col("most") >= limit.percent * F.col("n"))
        & (100 * F.col("n") >= limit.percent * F.col("least"))
        & ((100 + limit.percent) * F.least("rest", "onward") >= limit.percent * (F.col("n") + F.col("least")))
    )
    asked = held.drop("place").join(matrix, "token").filter(asks & fits)
    return asked.select(ROW, "label", "place").distinct()


def _open(cands: DataFrame, members: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """Links (a, b) of components between queries and the members of groups they qualify for.

    A group that very many rows ask is offered in copies, each to as many rows as it may have
    members.
    """
    busy = cands.groupBy("place").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("copies"))
    asked = _carry(cands.join(busy, "place"), sets).select(
        "place", F.pmod(F.xxhash64(ROW), F.col("copies")).cast("int").alias("copy"),
        F.lit(1).alias("kind"), "label", "tokens",
    )
    copy = F.explode(F.sequence(F.lit(0), F.col("copies") - 1))
    offered = _carry(members.join(busy, "place").withColumn("copy", copy), sets)
    offered = offered.select("place", "copy", F.lit(0).alias("kind"), "label", "tokens")

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, sets_, labels, ready = None, [], [], None
        for batch in batches:
            out = set()
            rows = zip(*(batch[c].tolist() for c in ("place", "copy", "kind", "label", "tokens")))
            for place, copy, kind, label, blob in rows:
                tokens = np.frombuffer(blob, np.uint64)
                if (place, copy) != here:
                    here, sets_, labels, ready = (place, copy), [], [], None
                if kind == 0:
                    sets_.append(tokens)
                    labels.append(label)
                    continue
                if ready is None:
                    ready = _matrix(sets_, labels)
                out.update((label, other) for other in _probe(tokens, label, ready, limit))
            yield pd.DataFrame(sorted(out), columns=["a", "b"]).astype(np.int64)
        release()

    met = asked.unionByName(offered)
    met = met.repartition("place", "copy").sortWithinPartitions("place", "copy", "kind")
    return met.mapInPandas(sweep, "a long, b long")


def _matrix(sets: list[np.ndarray], labels: list[int]):
    """A group's token union, the members that hold each token, and what they are."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    tokens = np.concatenate(sets)
    member = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    first, n = repeats.runs(tokens[order])
    return tokens[order][first], first, n, member[order], sizes, np.array(labels, np.int64)


def _probe(query: np.ndarray, label: int, matrix, limit: Threshold) -> set[int]:
    """Components of the members similar to a query, if the union's overlap admits any."""
    union, first, n, member, sizes, labels = matrix
    at = np.searchsorted(union, query)
    at = at[at < len(union)] if len(at) and at[-1] >= len(union) else at
    hit = at[union[at] == query[: len(at)]]
    if len(hit) < limit.least(len(query)):
        return set()
    both = np.bincount(member[spread_index(first[hit], n[hit])], minlength=len(sizes))
    similar = limit.holds(both, len(query), sizes)
    return set(labels[similar].tolist()) - {label}


def similar_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    percent: int = 75,
) -> DataFrame:
    """One row per input row: row number, ``id``, ``n`` (set size), ``component_id``, ``group``.

    A text's set are the n-grams of its words (maximal runs without ASCII white space, A-Z
    lower-cased); a text with fewer words is one n-gram, one without words has an empty
    set and no links. Two rows are linked if ``percent`` of the union of their sets is
    common. ``component_id`` is the smallest id reachable by links, the row's own
    included; null ids lose to all others. ``group`` is the row number of one of them, which
    tells components apart where ids repeat. Texts that are null count as empty, rows that
    repeat are linked with each other, extra columns are ignored, an empty table gives an
    empty table. A text is read whole however long it is; its set is the most one row holds.

    Steps: (1) rows most of whose tokens occur in no other row cannot have a link; a fixed
    share of the token space is looked at to find them. (2) Rows with equal sets become
    one. (3) Rows with the same smallest token form a group, cut if it is large, and are
    compared by a membership matrix; the best-linked row of each component then meets
    those of others that share its smallest token under this or another order. (4) Members of a component
    form groups of bounded size. The token-group matrix of the first tokens of all sets finds the
    groups of larger components a row could have a link into; tokens held by one component only
    and groups of other set sizes are left out. (5) A row opens a group if its overlap with the
    group's token union admits a link. No step looks at all pairs of a group of copies,
    and none drops a candidate.
    """
    rows = numbered(docs.select(*dict.fromkeys([id_col, text])))
    return _groups(rows, id_col, text, percent, words)


def _groups(
    given: DataFrame, id_col: str, text: str, percent: int = 75, words: int = WORDS
) -> DataFrame:
    """``similar_groups`` of ``numbered`` rows."""
    limit = Threshold(percent)
    read = _read(given, id_col, text)
    size = text_bytes(given, text)
    told = settle(
        _summaries(read.select(ROW, "body"), size, words).join(read.select(ROW, "id"), ROW), "sets"
    )
    name = ["name_a", "name_b", "n"]
    spare = F.col("n") - F.ceil(F.col("n") * percent / 100)
    could = told.filter((F.col("n") > 0) & (F.col("probed") - F.col("again") <= spare))
    classes = settle(could.groupBy(*name).agg(F.min(ROW).alias(ROW), F.min("id").alias("least")), "classes")
    sets = settle(_sets(read, classes, words), "tokens")

    sized = sets.select(ROW, *KEYS, F.octet_length("tokens").alias("bytes"))
    rows = settle(_cut(sized, "low"), "groups")
    inside = _inside(_carry(rows.filter("size > 1").select(ROW, "place"), sets), limit)
    members = rows.join(inside, ROW, "left").select(
        ROW, *KEYS, "bytes", "parts", "place", F.coalesce("root", ROW).alias("label"),
        F.coalesce("links", F.lit(0)).alias("links"),
    )
    members = settle(members, "members")
    for key in KEYS:
        members = _merge(members, key, sets, limit)

    # From here on a group holds similar documents: members of one component.
    members = settle(_cut(members.select(ROW, "label", "bytes"), "label").drop("parts"), "placed")
    places = settle(_places(sets, size), "places")
    firsts = _first_tokens(_carry(members.join(places.hint("merge"), ROW), sets), limit)
    cands = settle(_candidates(settle(firsts, "firsts"), limit), "candidates")
    last = components(_open(cands, members.select(ROW, "label", "place"), sets, limit))

    final = (
        members.join(last, F.col("label") == F.col("node"), "left")
        .select(ROW, F.coalesce("component", "label").alias("label"))
    )
    named = settle(classes.join(final, ROW), "named")
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "label").select(*name, "label", "component_id")
    return told.join(named, name, "left").select(
        ROW, "id", "n", F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce("label", ROW).alias("group"),
    )


def _places(sets: DataFrame, size: int) -> DataFrame:
    """Which tokens of each set, by their place, other sets hold as well."""

    def keys_of():
        def read_batch(batch: pd.DataFrame):
            held = _unpack(batch["tokens"])
            n = np.fromiter(map(len, held), np.int64, len(held))
            keys = np.concatenate([*held, np.zeros(0, np.uint64)])
            refs = np.repeat(batch[ROW].to_numpy(np.int64), n)
            return keys, refs, spread_index(np.zeros(len(n), np.int64), n)

        return read_batch

    rows = sets.select(ROW, "tokens")
    return repeats.repeated_places(rows, keys_of, parts_for(rows, size // 4), MOST, CROWD)


def _first_tokens(held: DataFrame, limit: Threshold) -> DataFrame:
    """The first tokens of each set, one per row, with its group, component and their sizes,
    and ``rest``, how many tokens from this one on other sets hold as well.

    The order of tokens is: those of one set only, the rest, crowded ones; by hash among
    themselves. It is the same for all sets, which is what the prefixes need; the first
    kind has no partner and is left out. A set of a row without ``places`` has no other
    kind, so it has no row here.
    """

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b.iloc[i : i + 512] for b in batches for i in range(0, len(b), 512)):
            parts, rest = [], []
            for tokens, x, y in zip(_unpack(batch["tokens"]), batch["x"], batch["y"]):
                at, crowded = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                order = np.lexsort((at, crowded))
                left = limit.prefix(len(tokens)) - (len(tokens) - len(at))
                parts.append(tokens[at[order[: max(0, left)]]])
                rest.append(len(at) - np.arange(len(parts[-1])))
            n = [len(p) for p in parts]
            if not sum(n):
                continue
            yield pd.DataFrame({
                "token": np.concatenate(parts).view(np.int64), "rest": np.concatenate(rest),
                **{c: np.repeat(batch[c].to_numpy(np.int64), n) for c in kept},
            })
        release()

    kept = [ROW, "place", "label", "size", "n"]
    schema = ", ".join(f"{c} long" for c in ["token", "rest", *kept])
    rows = held.withColumn("n", F.octet_length("tokens") / 8)
    return rows.select(*kept, "tokens", "x", "y").mapInPandas(explode, schema)


@keeps_columns
def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Of the rows of each component the one with the smallest id, columns as given.

    A null id counts as larger than others; of rows with the same id the first one read
    stays. Rows without words all stay.
    """
    rows = numbered(docs)
    found = _groups(rows, id_col, text, **options)
    best = F.min(F.struct(F.col("id").isNull(), "id", ROW)).alias("m")
    stay = found.groupBy("group").agg(best).select(F.col(f"m.{ROW}").alias(ROW))
    return rows.join(stay, ROW, "left_semi").select(*docs.columns)
