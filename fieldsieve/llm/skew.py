"""A join with one row per key where some keys have a great part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key with more than this share of all rows is broadcast, so at most 1 / SHARE are.
SHARE = 1 / 65536


def with_value(rows: DataFrame, table: DataFrame, keys: list[str], value: str, n: str, spread: list[str], share: float = SHARE) -> DataFrame:
    """`rows` LEFT JOIN `table` on `keys`, with the column `value` of the table; no task gets more than `share` of the rows for one key.

    `table` is stored, has each key once and tells its number of rows in `n`. Its keys with more than `share` of the sum of
    these are broadcast, 1 / share rows at most. A row with such a key needs no other; it is dealt by the columns
    `spread` instead, and what it may meet there by chance isn't taken.
    """
    limit = (table.agg(F.sum(n)).first()[0] or 0) * share
    heavy = F.broadcast(table.filter(F.col(n) > limit).select(*keys, F.col(value).alias("of_heavy")))
    others = [f"{k}_dealt" for k in keys]
    light = table.filter(F.col(n) <= limit).select(*[F.col(k).alias(o) for k, o in zip(keys, others)], F.col(value).alias("of_light"))
    known = F.col("of_heavy").isNotNull()
    out = rows.join(heavy, keys, "left")
    out = out.withColumns({o: F.when(known, F.xxhash64(F.lit(k), *spread).cast(rows.schema[k].dataType)).otherwise(F.col(k)) for k, o in zip(keys, others)})
    return out.join(light, others, "left").withColumn(value, F.coalesce("of_heavy", "of_light")).drop(*others, "of_heavy", "of_light")
