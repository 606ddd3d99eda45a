"""Parents, roots and ancestor domains, by doubling: chains of any length in a number of rounds that follows the logarithm of their length."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..tables import cut


def closure(orgs: DataFrame, id_: str, parent: str) -> DataFrame:
    """(node, ancestor, depth) with each node as its own ancestor at depth 0; a chain ends before it comes to itself again, and at an unknown parent.

    Round k knows ancestors up to a distance of 2^k; those at that distance lead on to what is known of them. Each round is stored, so
    plans don't grow. A node without an id adds nothing.
    """
    edges = orgs.select(F.col(id_).alias("node"), F.col(parent).alias("ancestor")).filter("node IS NOT NULL").distinct()
    ids = edges.select(F.col("node").alias("ancestor")).distinct()
    one = edges.join(ids, "ancestor", "left_semi").filter("node <> ancestor").select("node", "ancestor", F.lit(1).alias("depth"))
    known = cut(ids.select(F.col("ancestor").alias("node"), "ancestor", F.lit(0).alias("depth")).unionByName(one), "closure")
    reach = 1
    while True:
        tips = known.filter(F.col("depth") == reach).select("node", F.col("ancestor").alias("tip"))
        on = known.filter("depth > 0").select(F.col("node").alias("tip"), "ancestor", (F.col("depth") + reach).alias("depth"))
        new = cut(tips.join(on, "tip").select("node", "ancestor", "depth").join(known.select("node", "ancestor"), ["node", "ancestor"], "left_anti"), "closure")
        if not new.limit(1).count():
            return known
        known, reach = cut(known.unionByName(new), "closure"), 2 * reach


def problems(orgs: DataFrame, id_: str, parent: str) -> DataFrame:
    """(node, issue): nodes whose chain comes to itself again ('cycle') or ends at a parent that isn't there ('unknown parent')."""
    edges = orgs.select(F.col(id_).alias("root"), F.col(parent).alias("next"))
    ends = roots(closure(orgs, id_, parent)).join(edges, "root").filter("next IS NOT NULL")
    ids = edges.select(F.col("root").alias("next"), F.lit(True).alias("there")).distinct()
    return ends.join(ids, "next", "left").select("node", F.when(F.col("there"), "cycle").otherwise("unknown parent").alias("issue"))


def roots(closed: DataFrame) -> DataFrame:
    return closed.groupBy("node").agg(F.max_by("ancestor", "depth").alias("root"), F.max("depth").alias("depth"))


def ancestor_domains(closed: DataFrame, domains: DataFrame) -> DataFrame:
    """node, domains: those of its ancestors from near to far, each once, without its own. `domains` is (id, domain)."""
    of = domains.select(F.col("id").alias("ancestor"), "domain")
    own = domains.select(F.col("id").alias("node"), F.col("domain").alias("own"))
    rows = closed.filter("depth > 0").join(of, "ancestor").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("depth", "domain"))).alias("d"))
    return own.join(rows, "node", "left").select("node", F.array_remove(F.array_distinct(F.coalesce(F.col("d.domain"), F.array().cast("array<string>"))), F.col("own")).alias("domains"))
