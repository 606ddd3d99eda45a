"""Helpers for DataFrames that every part of the engine uses: free column names, tables in the shared folder, skew-proof minima."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def spread(df: DataFrame) -> DataFrame:
    """A stored table of fewer files than cores, and few megabytes a core, dealt out to all cores; others are as they are.

    A small file can be one row group, which is one task however many cores are idle. Large tables have splits enough.
    """
    cores, plan = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution().optimizedPlan()
    few = len(df._jdf.inputFiles()) < cores and int(str(plan.stats().sizeInBytes())) < cores << 24
    return df.repartition(cores) if few else df


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, one of our own on a single machine, and an error on a cluster."""
    sc = spark.sparkContext
    if not (named := spark.conf.get("spark.checkpoint.dir", None)):
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="fieldsieve-"))
        named = sc._jsc.sc().getCheckpointDir().get()
    return named.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """Where the tables of this application are; its owner is the application, and `clean` deletes it."""
    return f"{shared_folder(spark)}/fieldsieve-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, what: str = "table") -> DataFrame:
    """Writes `df` to the shared folder and reads it again: later stages survive a lost executor, and know its size."""
    path = f"{own_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", share: float = 1 / 1024) -> DataFrame:
    """`rows` joined (inner or left) with a `table` that has each key once, where some keys have a great part of the rows.

    Keys with more than `share` of the rows, 1 / share of them at most, are counted first; their rows of the table are broadcast, and the
    rows that have them stay where they are. Both tables are read twice: store them.
    """
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    limit = rows.count() * share
    heavy = [r[0] for r in counts.filter(F.col("n") > limit).select(key).collect()]
    if not heavy:
        return rows.join(table, key, how)
    is_heavy = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    light = rows.filter(~is_heavy).join(table.filter(~is_heavy), key, how)
    return light.unionByName(rows.filter(is_heavy).join(F.broadcast(table.filter(is_heavy)), key, how))


def clean(spark: SparkSession) -> bool:
    """Deletes all tables that `cut` wrote for this application; results that still read them can't be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
