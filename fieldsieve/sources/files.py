"""URL lists, state files and fetched bytes."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .versions import VersionedTable, is_versioned

STATE = "source_id string, last_successful_check_at timestamp"


def selected_urls(texts: DataFrame, content: str = "value", most: int = 20) -> DataFrame:
    """(line, url, input_duplicate) of a URL list: blank lines and lines with # first are skipped, lines keep their number.

    A line that is no http(s) URL, an empty list, and more than `most` lines are errors.
    """
    rows = texts.select(F.posexplode(F.split(content, "\r?\n")).alias("k", "raw")).select((F.col("k") + 1).alias("line"), F.trim("raw").alias("url")).filter("url <> '' AND NOT startswith(url, '#')")
    bad = rows.agg(F.count("*").alias("n"), F.sum((~F.regexp_like("url", F.lit("^https?://[^/ ]+"))).cast("int")).alias("bad")).first()
    if not 1 <= bad.n <= most or bad.bad:
        raise ValueError(f"{bad.n} URLs (1 to {most} are allowed), {bad.bad or 0} of them not http(s)")
    from ..operators.dedup import flag_repeats

    return flag_repeats(rows, ["url"], ["line"])


def _paths(spark: SparkSession, *names: str):
    jvm = spark.sparkContext._jvm
    paths = [jvm.org.apache.hadoop.fs.Path(n) for n in names]
    return paths[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), *paths


def _state_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, STATE, "source_id")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The state table: the last version of one in versions, or a folder of JSON files; a path that isn't there is an empty state, a broken one an error. A swap that was cut short left the old state beside its place."""
    fs, at, old = _paths(spark, path, path + ".old")
    there = path if fs.exists(at) else path + ".old" if fs.exists(old) else None
    if there is None:
        return spark.createDataFrame([], STATE)
    if is_versioned(spark, there):
        return _state_table(spark, there).read()
    return spark.read.schema(STATE).option("mode", "FAILFAST").json(there)


def upsert_state(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Rows of `new` replace those of their source, in a new version: runs that write at once both come to stand, the later one's rows last.

    A state in JSON files becomes the first version of one in versions, which is made beside it and renamed into its place.
    """
    fs, at, made, aside = _paths(spark, path, path + ".new", path + ".old")
    if not fs.exists(at) and fs.exists(aside) and not fs.rename(aside, at):
        raise OSError(f"{path}.old can't be moved back")
    rows = new.select("source_id", F.col("last_successful_check_at").cast("timestamp").alias("last_successful_check_at"))
    if not fs.exists(at) or is_versioned(spark, path):
        _state_table(spark, path).upsert(rows)
        return
    fs.delete(made, True)
    old = read_state(spark, path)
    _state_table(spark, path + ".new").upsert(old.join(rows.select("source_id"), "source_id", "left_anti").unionByName(rows))
    fs.delete(aside, True)
    if not fs.rename(at, aside) or not fs.rename(made, at):
        raise OSError(f"{path} can't be replaced")
    fs.delete(aside, True)


def write_json_atomic(path: str, text: str) -> None:
    """A report for one reader: written beside, then renamed."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(path + ".tmp", path)


def is_pdf(content: Column) -> Column:
    """Whether %PDF- stands in the first 1024 bytes."""
    return F.locate("%PDF-", F.decode(F.substring(content, 1, 1024), "ISO-8859-1")) > 0


def media_type(content_type: Column) -> Column:
    """The media type of a header, without parameters, in lower case."""
    return F.lower(F.trim(F.substring_index(content_type, ";", 1)))


def content_type_warning(kind: Column, content_type: Column) -> Column:
    """'no content type' or 'content type' where the header of a feed or page doesn't fit its kind (rss, list_page, single_page), else null."""
    c = F.lower(content_type)
    has = lambda x: F.contains(c, F.lit(x))
    feed, page = (kind == "rss") & ~has("xml") & ~has("rss"), kind.isin("list_page", "single_page") & ~has("text/html") & ~has("application/xhtml+xml")
    return F.when(content_type.isNull(), "no content type").when(feed | page, "content type")


def fetch_errors(fetched: DataFrame, most: int = 5 << 20, media: list[str] | None = None) -> DataFrame:
    """`error` of fetched rows (http_status, content, content_type): status, empty, too large, content_type (where `media` lists what is allowed), or null."""
    size = F.coalesce(F.length("content"), F.lit(0))
    error = F.when(~F.col("http_status").between(200, 299), "http_status").when(size == 0, "empty").when(size > most, "too_large")
    if media:
        error = error.when(~F.coalesce(media_type(F.col("content_type")).isin(media), F.lit(False)), "content_type")
    return fetched.withColumn("error", error)


def default_output(kind: str, key: str) -> str:
    """Where the latest report of a check is written; a key of other characters is an error."""
    import re

    if not re.fullmatch(r"[a-z0-9]+(?:-[a-z0-9]+)*", key):
        raise ValueError(f"{key!r} can't name a file")
    return f"data/logs/{kind}/{key}.json"


def access_gaps(accesses: DataFrame, least_ms: int = 1000, ties: list[str] | None = None) -> DataFrame:
    """`accesses` (host, at) with gap_ms to the host's access before, and early: whether that is less than `least_ms`; `ties` orders accesses of one time."""
    from pyspark.sql import Window

    before = F.lag("at").over(Window.partitionBy("host").orderBy("at", *(ties or [])))
    gap = F.unix_millis("at") - F.unix_millis(before)
    return accesses.withColumns({"gap_ms": gap, "early": F.coalesce(gap < least_ms, F.lit(False))})
