"""URL rules by a sorted sweep over reversed-host keys."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import ROW, ascii_lower, keeps_columns, numbered

# Keys the range cuts are chosen from, per partition.
CUT_SAMPLE = 64
# Ends the keys below a host: no host character is larger.
LAST = "\U0010ffff"


def url_host(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(F.coalesce(found, F.lit("")))


def url_path(url: str | Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: str | Column) -> Column:
    """``www.example.com`` to ``com.example.www.``: a host's subdomains share its key as prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


@keeps_columns
def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow"
) -> DataFrame:
    """Each page with ``host``, ``path``, ``rule`` and ``verdict`` added.

    ``rules`` has ``host``, ``path`` and ``verdict``. A rule fits its host and all
    subdomains if the page's path starts with the rule's; of the rules that fit, the one
    with the longest host and path wins, then the longer host, then the smaller verdict.
    Pages without a fitting rule, null and malformed urls among them, get ``default`` and
    a null rule. A url is read whole, however long; an empty table gives an empty table. Null
    parts of a rule count as empty; a rule without a host fits no page.
    Repeated pages are judged one by one, repeated rules count once. Columns of the same
    names as the new ones are replaced.

    A rule is the interval of keys from its reversed host to the last key below it; such
    intervals nest or are apart. Keys are cut into ranges, a hot key into several; a rule
    goes to each range its interval meets, which is one range except for the rules around
    a cut, as many per cut as the host there has labels. In a range, rules and pages are
    swept in key order with a stack of the rules whose interval is open.
    """
    spark = pages.sparkSession
    added = ["host", "path", "rule", "verdict"]
    given = [c for c in pages.columns if c not in added]
    base = numbered(pages.select(*given))
    base = base.withColumn("host", url_host(url)).withColumn("path", url_path(url))
    keyed = base.select(
        ROW, "host", "path", reversed_host("host").alias("key"), F.xxhash64(ROW).alias("spread")
    )

    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # About ranges * CUT_SAMPLE keys reach the driver, whatever the number of pages.
    share = min(1.0, ranges * CUT_SAMPLE / max(1, base.count()))
    some = F.pmod(F.xxhash64(ROW, F.lit(7)), F.lit(1 << 31)) < int(share * (1 << 31))
    picked = sorted(r.key for r in keyed.filter(some).select("key").collect())
    cuts = [picked[i * len(picked) // ranges] for i in range(1, ranges)] if picked else []

    span = _places(cuts)
    keyed = keyed.withColumn("at", span("key", "key"))
    # A key that fills several ranges is dealt over all of them.
    width = F.col("at.upto") - F.col("at.below") + 1
    place = F.col("at.below") + F.pmod(F.col("spread"), width.cast("long")).cast("int")
    asked = keyed.select(
        place.alias("range"), "key", F.lit(1).alias("kind"), ROW, "path",
        F.lit(None).cast("string").alias("verdict"),
    )
    listed = rules.select(
        ascii_lower(F.coalesce("host", F.lit(""))).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        "verdict",
    ).filter("host <> ''").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    listed = listed.withColumn("key", reversed_host("host"))
    listed = listed.withColumn("at", span("key", F.concat("key", F.lit(LAST))))
    offered = listed.select(
        F.explode(F.sequence("at.below", "at.upto")).alias("range"), "key",
        F.lit(0).alias("kind"), F.lit(-1).cast("long").alias(ROW), "path", "verdict",
    )
    met = (
        offered.unionByName(asked)
        .repartitionByRange(ranges, "range")
        .sortWithinPartitions("range", "key", "kind")
    )
    found = met.mapInPandas(_sweep, T.StructType([
        T.StructField(ROW, T.LongType()),
        T.StructField("rule", T.StringType()),
        T.StructField("verdict", T.StringType()),
    ]))
    judged = base.join(found, ROW, "left")
    return judged.select(
        *given, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


def _places(cuts: list[str]):
    """Column function: cuts below a first key, and cuts up to a last key."""

    @F.pandas_udf("below int, upto int")
    def places(first: pd.Series, last: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({
            "below": [bisect_left(cuts, x) for x in first],
            "upto": [bisect_right(cuts, x) for x in last],
        }, dtype="int32")

    return places


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One pass in key order; only the stack is carried from batch to batch."""
    here, stack = None, []  # (key, {path: verdict}, path lengths, host), outermost first
    for batch in batches:
        out: list[tuple[int, str, str]] = []
        columns = (batch[c].tolist() for c in ("range", "key", "kind", ROW, "path", "verdict"))
        for at, key, kind, row, path, verdict in zip(*columns):
            if at != here:
                here, stack = at, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    host = ".".join(reversed(key[:-1].split(".")))
                    stack.append((key, {}, [], host))
                stack[-1][1][path] = verdict
                if len(path) not in stack[-1][2]:
                    stack[-1][2].append(len(path))
                continue
            best = None
            for _, paths, sizes, host in stack:
                for n in sizes:
                    if n <= len(path) and path[:n] in paths:
                        rank = (len(host) + n, len(host))
                        if best is None or rank > best[0]:
                            best = rank, host + path[:n], paths[path[:n]]
            if best:
                out.append((int(row), best[1], best[2]))
        yield pd.DataFrame(out, columns=[ROW, "rule", "verdict"])
