"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(links: DataFrame) -> DataFrame:
    """node, label (least node of its component) for every node of links (a, b: long, undirected, repeats allowed; written).

    Each round a node takes the least label among itself, its neighbours and its label's label; the rounds needed grow with
    the logarithm of the longest path. Only label minima are shuffled, combined before the shuffle. Each round is written,
    so a lost executor costs one round.
    """
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    labels = settle(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        offers = edges.join(labels, edges["a"] == labels["node"]).select(F.col("b").alias("node"), "label", F.lit(None).cast("long").alias("was"))
        offers = offers.unionByName(labels.withColumn("was", F.col("label")))
        own = offers.groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = settle(own.join(up, "label", "left").select("node", "was", F.least("label", F.coalesce("top", "label")).alias("label")))
        changed = new.filter("label <> was").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (as of components, written) after further links (a, b; written). Only the components that a new link touches are worked on,
    each as one node, so the rounds do not read the links that came before."""
    ends = [labels.select(F.col("node").alias(end), F.col("label").alias(f"of_{end}")) for end in ("a", "b")]
    between = links.select("a", "b").join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    top = components(settle(between.filter("a <> b").distinct()))
    known = labels.join(top.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return settle(known.unionByName(top.join(labels.select("node"), "node", "left_anti")))
