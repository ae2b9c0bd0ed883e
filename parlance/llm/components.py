"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.session import settle


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) of all ends of links (a, b).

    Each round takes the smallest label among a node and its neighbours, then the label of
    that label, so the number of rounds grows with the logarithm of the longest path for
    paths and stays at two or three for the clusters near-duplicates form. Labels are
    written to the shared folder after each round, which cuts the lineage.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = settle(both.filter("a <> b").distinct(), "links")
    labels = settle(
        both.groupBy("a").agg(F.min("b").alias("low")).select(
            F.col("a").alias("node"), F.least("a", "low").alias("component")
        ),
        "labels",
    )
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(
            F.min("component").alias("low")
        )
        lower = labels.join(near, labels["node"] == near["a"], "left").select(
            "node", F.least("component", F.coalesce("low", "component")).alias("component"),
            F.col("component").alias("before"),
        )
        lower = settle(lower, "labels")
        up = lower.select(F.col("node").alias("component"), F.col("component").alias("top"))
        jumped = lower.join(up, "component", "left").select(
            "node", F.least("component", F.coalesce("top", "component")).alias("component"), "before"
        )
        jumped = settle(jumped, "labels")
        if jumped.filter("component <> before").isEmpty():
            return jumped.select("node", "component")
        labels = jumped.select("node", "component")
