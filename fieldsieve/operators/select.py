"""Limits that depend on rows before: slots, limits after an anti-join, breakers, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..tables import unused
from .dedup import before


def slot_selection(df: DataFrame, keys: list[str], order: list[str], ok: Column, failed: Column, print_: str, slots: int) -> DataFrame:
    """attempted, accepted: a first success or a failure takes a slot, repeats and the rest are skipped for free.

    What takes a slot are failures and the first success of each content; the first `slots` of these in order close the key. Both
    are ranked limits that tasks apply before the shuffle, so no window sees all rows of a key. Rows of a key differ in `order`.
    """
    place = F.struct(*order)
    marks = df.select(*keys, print_, place.alias("place"), ok.alias("ok"), failed.alias("failed")).filter("ok OR failed")
    firsts = marks.filter("ok").groupBy(*keys, print_).agg(F.min("place").alias("place")).select(*keys, "place", F.lit(True).alias("first"))
    takes = firsts.unionByName(marks.filter("failed AND NOT ok").select(*keys, "place", F.lit(False).alias("first")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("place"))
    taken = takes.withColumn("rank", rank).filter(F.col("rank") <= slots)
    # rows up to the last slot are attempted; where slots are left, all are
    found = taken.groupBy(*keys).agg(F.count("*").alias("used"), F.max("place").alias("last"), F.collect_set(F.when(F.col("first"), F.col("place"))).alias("places"))
    own = unused(df, "slots")
    found = found.select(*[F.col(k).alias(f"{own}_{n}") for n, k in enumerate(keys)], F.struct("used", "last", "places").alias(own))
    same = None
    for n, k in enumerate(keys):
        same = (c := df[k].eqNullSafe(found[f"{own}_{n}"])) if same is None else same & c
    out = df.join(found, same, "left")
    done = F.coalesce(F.col(f"{own}.used"), F.lit(0)) >= slots
    out = out.withColumn("attempted", ~done | (place <= F.col(f"{own}.last")) if slots > 0 else F.lit(False))
    out = out.withColumn("accepted", F.coalesce(F.col("attempted") & ok & F.array_contains(F.col(f"{own}.places"), place), F.lit(False)))
    return out.drop(own, *[f"{own}_{n}" for n in range(len(keys))])


def limit_new(df: DataFrame, keys: list[str], order: list[str], new: Column, limit: int) -> DataFrame:
    """state: known, processed or remaining; only new rows take up the limit."""
    return df.withColumn("state", F.when(~new, "known").when(before(new, keys, order) < limit, "processed").otherwise("remaining"))


def breaker(df: DataFrame, keys: list[str], order: list[str], hit: Column) -> DataFrame:
    """started: false for all rows behind the first hit."""
    return df.withColumn("started", before(hit, keys, order) == 0)


def group_breaker(df: DataFrame, place: str, hit: Column) -> DataFrame:
    """started: false as well for all rows of groups whose place is behind the first place with a hit. One minimum, no window over all rows."""
    name = unused(df, "first")
    first = df.filter(hit).agg(F.min(place).alias(name))
    return df.crossJoin(F.broadcast(first)).withColumn("started", F.col("started") & (F.col(name).isNull() | (F.col(place) <= F.col(name)))).drop(name)


def drop_low_if_any(df: DataFrame, keys: list[str], class_: str) -> DataFrame:
    """Without rows of the class `low`, where their key has a row of another class."""
    other, name = F.max((F.col(class_) != "low").cast("int")).over(Window.partitionBy(*keys)) == 1, unused(df, "other")
    return df.withColumn(name, other).filter(~F.col(name) | (F.col(class_) != "low")).drop(name)


def class_rank(class_: str) -> Column:
    """The order of classes: high, medium, other, low."""
    c = F.col(class_)
    return F.when(c == "high", 0).when(c == "medium", 1).when(c == "other", 2).otherwise(3)


def best_by_class(df: DataFrame, keys: list[str], class_: str, order: list[str], most: int) -> DataFrame:
    """The `most` best rows of each key by class and order, with their rank; low ones only where there is nothing else.

    A ranked window whose rows Spark limits before the shuffle; low ones come last, so those among the best of a key that has
    another one are just dropped, without a look at its other rows.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(class_rank(class_), *order))
    return drop_low_if_any(df.withColumn("rank", rank).filter(F.col("rank") <= most), keys, class_)


def first_rows(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each key."""
    name = unused(df, "k")
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= most).drop(name)


def with_latest(df: DataFrame, of: DataFrame, key: str, at: str, name: str = "latest") -> DataFrame:
    """`df` with the latest `at` of its key in `of`, nulls apart."""
    return df.join(of.groupBy(key).agg(F.max(at).alias(name)), key)


def water_fill(df: DataFrame, keys: list[str], order: list[str], length: str, total: int, most: int) -> DataFrame:
    """budget: each gets its length up to `most`; where that is more than `total` together, short ones get theirs and the others equal shares.

    In order of (cap, order) an item fits while its cap is at most the share of what is left; the rest is
    shared evenly and the remainder goes one by one to the first in the original order.
    """
    cap, whole, own, fits, rest, m, k = (unused(df, x) for x in ("cap", "sum", "own", "fits", "left", "m", "k"))
    df = df.withColumn(cap, F.least(F.col(length), F.lit(most)).cast("long"))
    all_ = Window.partitionBy(*keys)
    up = all_.orderBy(cap, *order)
    ahead = up.rowsBetween(Window.unboundedPreceding, -1)
    n = F.count("*").over(all_)
    share = F.floor((F.lit(total) - F.coalesce(F.sum(cap).over(ahead), F.lit(0))) / (n - F.row_number().over(up) + 1))
    df = df.withColumn(whole, F.sum(cap).over(all_)).withColumn(own, F.col(cap) <= share)
    df = df.withColumn(fits, F.min(F.col(own).cast("int")).over(up.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    left = F.lit(total) - F.coalesce(F.sum(F.when(F.col(fits), F.col(cap))).over(all_), F.lit(0))
    others = F.sum((~F.col(fits)).cast("int")).over(all_)
    df = df.withColumn(rest, left).withColumn(m, others).withColumn(k, before(~F.col(fits), keys, order))
    shared = F.floor(F.col(rest) / F.col(m)) + (F.col(k) < F.col(rest) % F.col(m)).cast("long")
    budget = F.when((F.col(whole) <= total) | F.col(fits), F.col(cap)).otherwise(shared)
    return df.withColumn("budget", budget.cast("long")).drop(cap, whole, own, fits, rest, m, k)
