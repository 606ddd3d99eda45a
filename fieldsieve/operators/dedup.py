"""First-wins deduplication and runs, as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..tables import unused


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order. Spark limits the ranked window before its shuffle, so a key of very many rows sends a row a task."""
    w, rn = Window.partitionBy(*keys).orderBy(*order), unused(df, "rn")
    return df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) == 1).drop(rn)


def flag_repeats(df: DataFrame, keys: list[str], order: list[str], name: str = "input_duplicate") -> DataFrame:
    """Whether an earlier row has the same key; `order` tells rows apart.

    The first of each key is a minimum that tasks take before the shuffle; only keys of several rows are joined back, so null and
    frequent keys meet in no window. Rows whose key has a null are compared as any other.
    """
    first, least = df.select(*keys, F.struct(*order).alias("place")), unused(df, "least")
    several = first.groupBy(*keys).agg(F.min("place").alias(least), F.max("place").alias("most")).filter(F.col(least) != F.col("most"))
    several = several.select(*[F.col(k).alias(f"{least}_{n}") for n, k in enumerate(keys)], least)
    same = None
    for n, k in enumerate(keys):
        same = (c := df[k].eqNullSafe(several[f"{least}_{n}"])) if same is None else same & c
    out = df.join(several, same, "left").withColumn(name, F.coalesce(F.struct(*order) != F.col(least), F.lit(False)))
    return out.drop(least, *[f"{least}_{n}" for n in range(len(keys))])


def islands(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Runs of consecutive values of `at`: keys, first_at, last_at, length."""
    run, name = F.col(at) - F.row_number().over(Window.partitionBy(*keys).orderBy(at)), unused(df, "run")
    grouped = df.select(*keys, at, run.alias(name)).groupBy(*keys, name)
    return grouped.agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("length")).drop(name)


def before(cond: Column, keys: list[str], order: list[str]) -> Column:
    """How many rows before this one meet the condition."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(cond.cast("int")).over(w), F.lit(0))
