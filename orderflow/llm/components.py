"""Connected components by repeated minimum labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (least node reachable) for every node of links (a long, b long).

    Each round takes the least label among neighbours, then the label of that label. A node of many links is joined
    with its links in a skewed join that Spark can split, and minima are taken before the shuffle.
    """
    edges = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    edges = cut(edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    labels = cut(edges.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")))
    while True:
        of = labels.select(F.col("node").alias("other"), F.col("component").alias("near"))
        nearest = edges.join(of, "other").groupBy("node").agg(F.min("near").alias("near"))
        hop = labels.join(nearest, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        far = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        following = cut(hop.join(far, "component").select("node", "was", F.least("component", "far").alias("component")))
        if not following.filter("component < was").limit(1).count():
            return following.select("node", "component")
        labels = following.select("node", "component")
