"""Clinical glossary: term table, nearest terms by vector, terms for phrases."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import rules
from parlance.functions.overlap import ngrams
from parlance.functions.rows import explode_rows
from parlance.functions.text import let, strip, words
from parlance.operators.ordering import head_rows

# Built-in terms as (english, marathi, hindi, category).
TERMS = [
    ("depression", "नैराश्य", "अवसाद", "symptom"),
    ("anxiety", "चिंता", "चिंता", "symptom"),
    ("stress", "ताण", "तनाव", "symptom"),
    ("insomnia", "निद्रानाश", "अनिद्रा", "symptom"),
    ("fatigue", "थकवा", "थकान", "symptom"),
    ("hopelessness", "निराशा", "निराशा", "symptom"),
    ("irritability", "चिडचिड", "चिड़चिड़ापन", "symptom"),
    ("panic attack", "घबराट", "घबराहट का दौरा", "symptom"),
    ("mood swings", "मनःस्थिती बदल", "मिजाज में बदलाव", "symptom"),
    ("loss of interest", "रुची कमी होणे", "रुचि में कमी", "symptom"),
    ("concentration problems", "एकाग्रता समस्या", "एकाग्रता की समस्या", "symptom"),
    ("appetite changes", "भूक बदल", "भूख में बदलाव", "symptom"),
    ("sleep disturbance", "झोपेत अडथळा", "नींद में खलल", "symptom"),
    ("low energy", "कमी ऊर्जा", "कम ऊर्जा", "symptom"),
    ("worthlessness", "निरर्थकता", "बेकार होने का एहसास", "symptom"),
    ("guilt", "अपराधीपणा", "अपराध बोध", "symptom"),
    ("suicidal thoughts", "आत्महत्येचे विचार", "आत्महत्या के विचार", "symptom"),
    ("self-harm", "स्वतःला इजा", "आत्म-हानि", "symptom"),
    ("major depressive disorder", "मुख्य नैराश्य विकार", "प्रमुख अवसादग्रस्तता विकार", "diagnosis"),
    ("generalized anxiety disorder", "सामान्यीकृत चिंता विकार", "सामान्यीकृत चिंता विकार", "diagnosis"),
    ("bipolar disorder", "द्विध्रुवीय विकार", "द्विध्रुवी विकार", "diagnosis"),
    ("PTSD", "आघातोत्तर ताण विकार", "पीटीएसडी", "diagnosis"),
    ("social anxiety", "सामाजिक चिंता", "सामाजिक चिंता", "diagnosis"),
    ("mild", "सौम्य", "हल्का", "severity"),
    ("moderate", "मध्यम", "मध्यम", "severity"),
    ("severe", "तीव्र", "गंभीर", "severity"),
    ("minimal", "अत्यल्प", "न्यूनतम", "severity"),
    ("psychotherapy", "मानसोपचार", "मनोचिकित्सा", "treatment"),
    ("cognitive behavioral therapy", "संज्ञानात्मक वर्तणूक उपचार", "संज्ञानात्मक व्यवहार थेरेपी", "treatment"),
    ("counseling", "समुपदेशन", "परामर्श", "treatment"),
    ("medication", "औषधोपचार", "दवाई", "treatment"),
    ("antidepressant", "प्रतिनैराश्यक", "अवसादरोधी", "treatment"),
    ("follow-up", "पाठपुरावा", "अनुवर्ती", "treatment"),
    ("chief complaint", "मुख्य तक्रार", "मुख्य शिकायत", "soap"),
    ("history of present illness", "सध्याच्या आजाराचा इतिहास", "वर्तमान बीमारी का इतिहास", "soap"),
    ("assessment", "मूल्यांकन", "मूल्यांकन", "soap"),
    ("treatment plan", "उपचार योजना", "उपचार योजना", "soap"),
    ("risk assessment", "जोखीम मूल्यांकन", "जोखिम मूल्यांकन", "soap"),
    ("prognosis", "रोगनिदान", "पूर्वानुमान", "soap"),
]

# Phrase lookup takes 1-3 words over 3 characters, two hits per phrase,
# ten terms per text.
PHRASE_WORDS, PHRASE_MIN_CHARS, PHRASE_HITS, TEXT_TERMS = 3, 3, 2, 10

# Terms in a cluster on average, and clusters at most: their centres go to every task.
CLUSTER_TERMS, CLUSTERS = 1024, 512
# How far a bound on a similarity may be off: angles near zero have half the digits of cosines.
SLACK = 1e-7
# Terms in a block, blocks of that size before blocks grow and terms in a grown one, queries in
# a group, and similarities held at once.
BLOCK_TERMS = 4096
FEW_BLOCKS, MOST_TERMS = 8, 32_768
GROUP_QUERIES = 20_000
TILE = 1 << 21
# Texts the model is given at once.
EMBED_ROWS = 4096
# Digits by which similarities are compared: sums may differ behind them from block to block.
DIGITS = 12


def term_table(spark: SparkSession) -> DataFrame:
    """The built-in glossary."""
    return spark.createDataFrame(TERMS, "english string, marathi string, hindi string, category string")


def _nearest(vectors: np.ndarray, matrix: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Query rows, term columns and similarities of the ``k`` best terms by cosine, the
    first listed on a tie; a vector without length has similarity 0 to all."""
    scale = np.linalg.norm(matrix, axis=1)
    k, step = min(k, len(matrix)), max(1, TILE // max(1, len(matrix)))
    rows, columns, values = [], [], []
    for lo in range(0, len(vectors), step):
        q = vectors[lo:lo + step]
        size = np.linalg.norm(q, axis=1)[:, None] * scale
        sims = np.divide(q @ matrix.T, size, out=np.zeros((len(q), len(matrix))), where=size > 0)
        sims = np.round(sims, DIGITS)
        least = np.partition(sims, -k, axis=1)[:, -k]
        at, term = np.nonzero(sims >= least[:, None])
        found = sims[at, term]
        order = np.lexsort((term, -found, at))
        at, term, found = at[order], term[order], found[order]
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        rows.append(at[nth < k] + lo)
        columns.append(term[nth < k])
        values.append(found[nth < k])
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(values)


class Clusters(NamedTuple):
    """Terms around centres: unit vectors, largest angle to a member, and number of members.

    The last cluster has no centre; it holds the vectors without length.
    """

    centres: np.ndarray
    radius: np.ndarray
    size: np.ndarray

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster of each vector and its angle to the centre."""
        angles = _angles(vectors, self.centres)
        at = angles.argmin(axis=1)
        found = angles[np.arange(len(at)), at]
        plain = np.linalg.norm(vectors, axis=1) > 0
        return np.where(plain, at, len(self.centres)), np.where(plain, found, 0.0)

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """No member of a cluster is more similar to a vector than this; -2 where it has none."""
        near = np.cos(np.maximum(_angles(vectors, self.centres) - self.radius[:-1], 0))
        near[np.linalg.norm(vectors, axis=1) == 0] = 0
        bound = np.column_stack([near, np.zeros(len(vectors))])
        return np.where(self.size > 0, bound, -2.0)

    def first(self, bounds: np.ndarray, k: int) -> np.ndarray:
        """The clusters with the highest bounds that have ``k`` members together."""
        order = np.argsort(-bounds, axis=1, kind="stable")
        before = np.cumsum(self.size[order], axis=1) - self.size[order]
        chosen = np.zeros(bounds.shape, bool)
        np.put_along_axis(chosen, order, before < k, axis=1)
        return chosen & (bounds > -2)


def _angles(vectors: np.ndarray, units: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1)[:, None]
    cosines = np.divide(vectors @ units.T, length, out=np.zeros((len(vectors), len(units))), where=length > 0)
    return np.arccos(np.clip(cosines, -1, 1))


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors).astype(np.float64)


def cluster_terms(terms: DataFrame) -> tuple[DataFrame, Clusters] | None:
    """Terms with their ``cluster``, and the clusters; None for too few terms to tell apart.

    Centres are terms drawn by a hash of their id, ``CLUSTERS`` at most; they and one row of
    figures per cluster are all that comes to the driver.
    """
    n = terms.count()
    wanted = min(CLUSTERS, -(-n // CLUSTER_TERMS))
    if wanted <= 1:
        return None
    drawn = terms.orderBy(F.xxhash64("term_id"), "term_id").limit(wanted).select("vector").toPandas()
    centres = _stack(drawn["vector"])
    centres = np.unique(centres[np.linalg.norm(centres, axis=1) > 0], axis=0)
    if not len(centres):
        return None
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    bare = Clusters(centres, np.zeros(len(centres) + 1), np.zeros(len(centres) + 1, np.int64))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, angle = bare.nearest(_stack(pdf["vector"])) if len(pdf) else ([], [])
            yield pdf.assign(cluster=at, angle=angle)

    kind = terms.schema["term_id"].dataType.simpleString()
    placed = terms.select("term_id", F.col("vector").cast("array<double>").alias("vector")).mapInPandas(
        place, f"term_id {kind}, vector array<double>, cluster int, angle double"
    )
    for r in placed.groupBy("cluster").agg(F.max("angle").alias("r"), F.count("*").alias("n")).collect():
        bare.radius[r["cluster"]], bare.size[r["cluster"]] = r["r"], r["n"]
    return placed.drop("angle"), bare


def opened_first(queries: DataFrame, clusters: Clusters, k: int) -> DataFrame:
    """Queries with the clusters they start with."""
    return _each(_first(queries, clusters, k))


def opened_next(queries: DataFrame, found: DataFrame, clusters: Clusters, k: int) -> DataFrame:
    """Queries with the further clusters whose bound the ``k``-th best found does not beat."""
    return _each(_next(queries, found, clusters, k))


def _each(listed: DataFrame) -> DataFrame:
    """One row per query and cluster it opens."""
    return listed.select("query_id", "vector", F.explode("opened").alias("cluster"))


def _first(queries: DataFrame, clusters: Clusters, k: int) -> DataFrame:
    return _opened(queries, lambda pdf, bounds: clusters.first(bounds, k), clusters)


def _next(queries: DataFrame, found: DataFrame, clusters: Clusters, k: int) -> DataFrame:
    worst = found.groupBy("query_id").agg(F.min("similarity").alias("worst"), F.count("*").alias("n"))
    known = queries.join(worst, "query_id", "left").select(
        "query_id", "vector", F.when(F.col("n") >= k, F.col("worst")).otherwise(-2.0).alias("worst")
    )

    def choose(pdf: pd.DataFrame, bounds: np.ndarray) -> np.ndarray:
        open_ = bounds + SLACK >= pdf["worst"].to_numpy()[:, None]
        return open_ & (bounds > -2) & ~clusters.first(bounds, k)

    return _opened(known, choose, clusters)


def _opened(
    queries: DataFrame, choose: Callable[[pd.DataFrame, np.ndarray], np.ndarray], clusters: Clusters
) -> DataFrame:
    """Queries with the list of clusters they open."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            chosen = choose(pdf, clusters.bounds(_stack(pdf["vector"]))) if len(pdf) else []
            listed = [np.flatnonzero(c).astype(np.int32) for c in chosen]
            yield pd.DataFrame({"query_id": pdf["query_id"], "vector": pdf["vector"], "opened": listed})

    kind = queries.schema["query_id"].dataType.simpleString()
    rows = queries.withColumn("vector", F.col("vector").cast("array<double>"))
    return rows.mapInPandas(run, f"query_id {kind}, vector array<double>, opened array<int>")


def _nearest_opened(
    opened: pd.Series, vectors: np.ndarray, cluster: np.ndarray, matrix: np.ndarray, k: int
) -> tuple[np.ndarray, ...]:
    """As ``_nearest``, among the terms of the clusters that a query opens."""
    count = opened.map(len).to_numpy()
    query, wanted = np.repeat(np.arange(len(opened)), count), np.concatenate(opened.to_list())
    rows, columns, values = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    for c in np.unique(cluster):
        mine, members = query[wanted == c], np.flatnonzero(cluster == c)
        if not len(mine):
            continue
        at, term, found = _nearest(vectors[mine], matrix[members], k)
        rows, columns = np.append(rows, mine[at]), np.append(columns, members[term])
        values = np.append(values, found)
        if len(rows) > 2 * k * len(vectors):
            rows, columns, values = _leading(rows, columns, values, k)
    return _leading(rows, columns, values, k)


def _leading(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best per row."""
    order = np.lexsort((columns, -values, rows))
    rows, columns, values = rows[order], columns[order], values[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[kept], columns[kept], values[kept]


def _compare(asked: DataFrame, offered: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` nearest terms a group of queries has in each block it meets.

    Where queries list the clusters they open, each is compared with the terms of those alone.
    """

    def meet(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(t):
            return pd.DataFrame(columns=["query_id", "term_id", "similarity"])
        t = t.sort_values("term_id")
        asked, offered = _stack(q["vector"]), _stack(t["vector"])
        if "opened" not in q:
            rows, columns, values = _nearest(asked, offered, k)
        else:
            rows, columns, values = _nearest_opened(q["opened"], asked, t["cluster"].to_numpy(), offered, k)
        return pd.DataFrame({
            "query_id": q["query_id"].to_numpy()[rows], "term_id": t["term_id"].to_numpy()[columns],
            "similarity": values,
        })

    q_type, t_type = (
        df.schema[c].dataType.simpleString() for df, c in ((asked, "query_id"), (offered, "term_id"))
    )
    return asked.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInPandas(
        meet, f"query_id {q_type}, term_id {t_type}, similarity double"
    )


def _groups_of(df: DataFrame, size: int) -> Column:
    """How many groups of about ``size`` rows there are, worked out within the query."""
    return df.agg(F.greatest(F.ceil(F.count("*") / size), F.lit(1)).cast("long").alias("n")).scalar()


def _shares(clusters: Clusters) -> tuple[list[int], list[int]]:
    """Block at which a cluster begins, and number of blocks it has to itself; 0 where it shares one.

    A query is sent once to a block, so neighbouring clusters share blocks. Up to ``FEW_BLOCKS``
    blocks are of ``BLOCK_TERMS`` terms, more terms make larger ones of ``MOST_TERMS`` at most.
    """
    grown = -(-int(clusters.size.sum()) // FEW_BLOCKS)
    limit = max(BLOCK_TERMS, min(MOST_TERMS, grown))
    start, own, block, held = [], [], 0, 0
    for n in clusters.size.tolist():
        if held and held + n > limit:
            block, held = block + 1, 0
        start.append(block)
        own.append(-(-n // limit) if n > limit else 0)
        held += n
        if own[-1]:
            block, held = block + own[-1], 0
    return start, own


def _in_opened(asked: DataFrame, placed: DataFrame, queries: DataFrame, clusters: Clusters, k: int) -> DataFrame:
    """Nearest terms among those of opened clusters; a query goes once to each block that holds some.

    ``asked`` has one row per query and ``cluster``, or the clusters of a query as ``opened``.
    """
    if "opened" not in asked.columns:
        asked = asked.withColumn("opened", F.array("cluster"))
    start, own = (F.lit(x) for x in _shares(clusters))

    def blocks_of(c: Column) -> Column:
        return F.sequence(F.get(start, c), F.get(start, c) + F.greatest(F.get(own, c) - 1, F.lit(0)))

    salt = F.pmod(F.xxhash64("query_id"), _groups_of(queries, GROUP_QUERIES)).alias("salt")
    placing = F.transform("opened", lambda c: F.struct(c.alias("cluster"), blocks_of(c).alias("blocks")))
    asked = asked.select("query_id", "vector", salt, placing.alias("_p")).select(
        "query_id", "vector", "salt", "_p", F.explode(F.array_distinct(F.flatten("_p.blocks"))).alias("block")
    )
    mine = F.filter("_p", lambda p: F.array_contains(p["blocks"], F.col("block")))
    asked = asked.select("query_id", "vector", "salt", "block", F.transform(mine, lambda p: p["cluster"]).alias("opened"))
    # Only blocks that some group of queries opens go out, once for each such group.
    wanted = asked.select(F.col("block").alias("_block"), F.col("salt").alias("_salt")).distinct()
    part = F.pmod(F.xxhash64("term_id"), F.greatest(F.get(own, F.col("cluster")), F.lit(1))).cast("int")
    offered = placed.withColumn("block", F.get(start, F.col("cluster")) + part).join(
        wanted, F.col("block") == F.col("_block")
    ).select("term_id", "vector", "cluster", "block", F.col("_salt").alias("salt"))
    return _compare(asked, offered, ["block", "salt"], k)


def term_topk(queries: DataFrame, terms: DataFrame, k: int = 5, clustered: bool = True) -> DataFrame:
    """``k`` nearest terms of each query vector by cosine, exact for any glossary size.

    ``queries``: query_id, vector. ``terms``: term_id, vector. Terms are put into clusters
    around drawn centres. The angle between a query and a centre, less the cluster's radius,
    bounds the similarity of all its members, so a query first opens the clusters with the
    highest bounds that have ``k`` terms, then those whose bound its ``k``-th best similarity
    does not beat; the others cannot hold a nearer term, nor one as near. What is opened is
    compared in groups of queries and blocks of terms, both bounded, tile by tile.

    Vectors without length have similarity 0 to all; ties go to the smaller term_id. Where
    terms are too few for clusters, or ``clustered`` is off, all groups meet all blocks.
    """
    cut = cluster_terms(terms) if clustered else None
    if cut is None:
        blocks, groups = _groups_of(terms, BLOCK_TERMS), _groups_of(queries, GROUP_QUERIES)

        def copies(df: DataFrame, id_col: str, own: str, mine: Column, other: str, theirs: Column) -> DataFrame:
            held = df.select(id_col, "vector", mine.alias("_own"), theirs.alias("_other"))
            return held.select(
                id_col, "vector", F.pmod(F.xxhash64(id_col), F.col("_own")).alias(own),
                F.explode(F.sequence(F.lit(0).cast("long"), F.col("_other") - 1)).alias(other),
            )

        asked = copies(queries, "query_id", "salt", groups, "block", blocks)
        offered = copies(terms, "term_id", "block", blocks, "salt", groups)
        return _best(_compare(asked, offered, ["block", "salt"], k), ["query_id"], "term_id", k)
    placed, clusters = cut
    first = _in_opened(_first(queries, clusters, k), placed, queries, clusters, k)
    first = _best(first, ["query_id"], "term_id", k)
    further = _in_opened(_next(queries, first, clusters, k), placed, queries, clusters, k)
    return _best(first.unionByName(further), ["query_id"], "term_id", k)


def _best(found: DataFrame, keys: list[str], term: str, k: int) -> DataFrame:
    return head_rows(found, keys, [F.col("similarity").desc(), F.col(term).asc()], k)


def phrases_of(c: Column) -> Column:
    """Distinct runs of 1-3 neighbouring words longer than three characters."""
    plain = F.replace(F.replace(c, F.lit(","), F.lit(" ")), F.lit("."), F.lit(" "))
    runs = let(words(plain), lambda w: F.concat(*[ngrams(w, n + 1) for n in range(PHRASE_WORDS)]))
    return F.array_distinct(F.filter(runs, lambda p: F.length(p) > PHRASE_MIN_CHARS))


def letter_vectors(texts: Sequence[str]) -> np.ndarray:
    """Stand-in embedding: counts of the letters a-z."""
    out = np.zeros((len(texts), 26))
    for row, t in enumerate(texts):
        codes = np.frombuffer(t.lower().encode("utf-8"), dtype=np.uint8)
        out[row] = np.bincount(codes, minlength=256)[97:123]
    return out


def embedded(df: DataFrame, text: str, embed: Callable[[Sequence[str]], np.ndarray], name: str) -> DataFrame:
    """Distinct texts as ``name`` with their vectors; ``embed`` is the user's model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), EMBED_ROWS):
                part = pdf[name].iloc[lo:lo + EMBED_ROWS].tolist()
                yield pd.DataFrame({name: part, "vector": list(np.asarray(embed(part), dtype=np.float64))})

    distinct = df.select(F.col(text).alias(name)).filter(F.col(name).isNotNull()).distinct()
    return distinct.mapInPandas(run, f"{name} string, vector array<double>")


def phrase_terms(
    texts: DataFrame,
    key: list[str],
    embed: Callable[[Sequence[str]], np.ndarray] = letter_vectors,
    top: int = TEXT_TERMS,
    glossary: DataFrame | None = None,
    hits: int = PHRASE_HITS,
) -> DataFrame:
    """Best glossary terms of each text: two per phrase, best score per term, top ten.

    ``glossary`` has a column ``english``, as ``term_table`` and ``scan_glossary`` give it.
    Each distinct phrase is embedded and looked up once, whatever the number of texts that
    hold it, and only the best score per text and term goes on. The phrases of all texts are
    many times the texts that Spark estimates them by, so neither side of their join is broadcast.
    """
    terms = term_table(texts.sparkSession) if glossary is None else glossary
    phrases = explode_rows(texts, [*key], phrases_of(F.col("text")), "query_id")
    near = term_topk(
        embedded(phrases, "query_id", embed, "query_id"), embedded(terms, "english", embed, "term_id"), hits,
        clustered=glossary is not None,
    )
    scored = phrases.hint("merge").join(near, "query_id").groupBy(*key, F.col("term_id").alias("english")).agg(
        F.max("similarity").alias("similarity")
    )
    return _best(scored, key, "english", top)


# Runs of letters, digits and underscores: what lies between two word borders.
WORD_RUN = r"(?U)\w+"


def vocabulary_of(glossary: DataFrame) -> DataFrame:
    """Terms and wordings out of a glossary as ``term_table`` and ``scan_glossary`` give it.

    Terms are lower-cased, longer ones come first; of equal terms the first wording by
    letters is taken. Terms without a wording are left out.
    """
    term, wording = F.lower(strip(F.col("english"))), F.coalesce(F.nullif("marathi", F.lit("")), "hindi")
    terms = glossary.select(term.alias("term"), wording.alias("wording"))
    return (
        terms.filter("term <> '' AND wording <> ''").groupBy("term").agg(F.min("wording").alias("wording"))
        .select(F.struct(-F.length("term"), "term").alias("place"), "term", "wording")
    )


def substitute_terms(
    rows: DataFrame, vocabulary: DataFrame, key: list[str], text: str = "text"
) -> DataFrame:
    """Rows whose ``text`` has whole-word terms replaced, for a vocabulary of any size.

    ``vocabulary``: place, term, wording; terms take effect in order of place. The words of a
    text, one up to as many in a row as the longest term has, are looked up in the
    vocabulary's terms, so a text meets the terms it may hold and no others, and the plan
    is the same for ten terms and for millions. What is found comes back to the row by
    ``key`` (rows that share a key share candidates, each is judged by its own text) and is
    applied as ``rules.word_terms`` does. Null texts stay null; terms without a letter or
    digit are not looked for; other columns pass through.
    """
    terms = vocabulary.filter("wording <> '' AND NOT startswith(term, '_')").select(
        "place", "term", "wording", F.regexp_extract_all("term", F.lit(WORD_RUN), F.lit(0)).alias("_w")
    ).filter(F.size("_w") > 0)
    longest = F.coalesce(terms.agg(F.max(F.size("_w"))).scalar(), F.lit(1))
    by_words = terms.select(F.array_join("_w", " ").alias("_run"), "place", "term", "wording")
    said = F.regexp_extract_all(F.lower(text), F.lit(WORD_RUN), F.lit(0))

    def runs(w: Column) -> Column:
        n = F.size(w)
        sizes = F.sequence(F.lit(1), F.greatest(F.least(F.col("_longest"), n), F.lit(1)))
        of_size = F.transform(
            sizes,
            lambda k: F.transform(
                F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))),
                lambda i: F.array_join(F.slice(w, i, k), " "),
            ),
        )
        return F.array_distinct(F.flatten(of_size))

    asked = explode_rows(rows.withColumn("_longest", longest), [*key], let(said, runs), "_run")
    hit = F.struct("place", "term", "wording")
    found = asked.join(by_words, "_run").groupBy(*[F.col(k).alias(f"_k_{k}") for k in key]).agg(
        F.sort_array(F.collect_set(hit)).alias("_hits")
    )
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    met = rows.join(found, same, "left")
    new = F.when(F.col("_hits").isNull(), F.col(text)).otherwise(rules.word_terms(F.col(text), F.col("_hits")))
    return met.withColumn(text, new).select(*rows.columns)
