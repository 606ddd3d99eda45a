"""Connected components of links, without bringing links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .lineage import cut
from .skew import with_value


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b); the label is the smallest node that can be reached.

    Each round a node takes the smallest label next to it, then the label of its label. Both are
    aggregations with map-side combining, and the joins carry two numbers a row. A node with a great part of all links,
    and a label that a great part of all nodes has, are broadcast, so their rows meet in no one task. Rounds end when no label changes.
    Nulls and links of a node with itself add nothing; no links give no rows.
    """
    good = links.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    both = cut(good.union(good.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label"), F.count("*").alias("links")), "labels")
    while True:
        near = with_value(both, labels.withColumnRenamed("node", "b"), ["b"], "label", "links", ["a"]).groupBy("a").agg(F.min("label").alias("near"))
        step = cut(labels.join(near, labels.node == near.a).select("node", "links", F.col("label").alias("old"), F.least("label", "near").alias("mid")), "step")
        times = step.groupBy("mid").agg(F.count("*").alias("times"))
        of = cut(labels.select(F.col("node").alias("mid"), F.col("label").alias("jump")).join(times, "mid"), "jumps")
        jumped = with_value(step, of, ["mid"], "jump", "times", ["node"])
        new = cut(jumped.select("node", "links", "old", F.least("mid", F.coalesce("jump", "mid")).alias("label")), "labels")
        changed = new.filter("label <> old").limit(1).count()
        labels = new.select("node", "label", "links")
        if not changed:
            return labels.drop("links")
