"""Calls that are paid for: made once a row, stored as they end, and in waves where a used-up limit has to stop the rest."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..tables import cut, own_folder, unused

Call = Callable[[DataFrame], DataFrame]

#: A task's rows are in place when it ends, not only when its job does.
_AT_ONCE = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def stored_results(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    """What calls have left at a path, each key once; null before the first. A job that was cut short has left what its finished tasks made."""
    from pyspark.errors import AnalysisException

    if not exists(spark, path):
        return None
    try:
        return spark.read.parquet(path).dropDuplicates(keys)
    except AnalysisException:  # a folder without a finished task
        return None


def called_once(inputs: DataFrame, keys: list[str], call: Call, path: str, tasks: int | None = None) -> DataFrame:
    """The results of `call` for the rows of `inputs`, whose `keys` are unique; rows with a result at `path` are not called again.

    `call` maps rows to results that keep the keys. Results are appended task by task, so that after a kill, or a lost job, only the rows
    of tasks that hadn't ended are called anew; rows are dealt to `tasks` tasks (by default one each up to 64 a core). What is asked
    of the result reads the store and calls nothing. Null keys are an error of the caller's: they would be called each time.
    """
    spark = inputs.sparkSession
    known = stored_results(spark, path, keys)
    left = inputs if known is None else inputs.join(known.select(*keys), keys, "left_anti")
    left = cut(left, "calls")
    if n := left.count():
        made = call(left.repartition(min(n, tasks or 64 * spark.sparkContext.defaultParallelism)))
        made.write.options(**_AT_ONCE).mode("append").parquet(path)
    elif known is None:
        return call(left)
    return stored_results(spark, path, keys).join(inputs.select(*keys), keys, "left_semi")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """`df`, stored, with its place from 0 in the given order, which is total: sorted by ranges, then counted by range; no task sees all rows."""
    at = unused(df, "at")
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "sorted")
    part = F.shiftright(at, 33)
    counts = sorted((r.part, r["count"]) for r in rows.groupBy(part.alias("part")).count().collect())
    offset, pairs = 0, []
    for p, n in counts:
        pairs += [F.lit(p), F.lit(offset)]
        offset += n
    first = F.element_at(F.create_map(*pairs), part) if pairs else F.lit(0)
    return rows.withColumn(name, (first + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop(at)


def in_waves(work: DataFrame, order: list[str], keys: list[str], call: Call, path: str, size: int, hit: str = "limit_hit") -> DataFrame:
    """`work` in `order`, called in waves of `size` rows until one has a row with `hit`: the rows called, with their results, rank, wave and started.

    Each wave's results are stored before the next is launched. The order is stored first, and a run that finds it at `path` goes on with the
    first wave that isn't complete, so `work` counts only the first time. started is false for rows of the last wave behind the first hit: they
    were called, as a wave is launched whole, and count for nothing. Calls are at most the rows up to the first hit and the rest of its wave.
    """
    spark = work.sparkSession
    rank, wave = "rank", "wave"
    if not exists(spark, f"{path}/queue/_SUCCESS"):
        numbered(work, order, rank).withColumn(wave, F.expr(f"rank div {size}")).write.mode("overwrite").parquet(f"{path}/queue")
    queue = spark.read.parquet(f"{path}/queue")
    results = f"{path}/results"
    waves = {r.wave: r["count"] for r in queue.groupBy(wave).count().collect()}
    known = stored_results(spark, results, keys)
    first, told = None, {}
    if known is not None:
        of = queue.select(*keys, rank, wave).join(known, keys)
        told = {r.wave: r for r in of.groupBy(wave).agg(F.count("*").alias("n"), F.min(F.when(F.col(hit), F.col(rank))).alias("first")).collect()}
    for k in sorted(waves):
        if k not in told or told[k].n < waves[k]:
            made = called_once(queue.filter(F.col(wave) == k), keys, call, results)
            first = made.filter(hit).join(queue.select(*keys, rank), keys).agg(F.min(rank)).first()[0]
        else:
            first = told[k].first
        if first is not None:
            break
    found = stored_results(spark, results, keys)
    if found is None:
        found = call(queue.limit(0))
    extra = [c for c in found.columns if c not in queue.columns]
    return queue.join(found.select(*keys, *extra), keys).withColumn("started", F.lit(first is None) | (F.col(rank) <= F.lit(-1 if first is None else first)))


def new_store(spark: SparkSession, what: str) -> str:
    """A path of this application for calls that no later run goes on with."""
    return f"{own_folder(spark)}/{what}-{uuid.uuid4().hex}"
