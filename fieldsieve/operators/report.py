"""Report rows and text tables."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import preview


def report_rows(df: DataFrame, body: str, pages: str | None = None) -> DataFrame:
    """Without the large columns; a preview and lengths in their place."""
    out = df.withColumn("preview", preview(F.col(body))).withColumn("characters", F.length(body))
    if pages:
        out = out.withColumn("page_characters", F.transform(pages, F.length)).drop(pages)
    return out.drop(body)


def histogram(results: DataFrame) -> DataFrame:
    """ok, warning, error, unsupported of `status`."""
    return results.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "warning", "error", "unsupported")])


def bad_outcome(single: Column | None = None) -> Column:
    """Whether a result asks for an exit code of 1: an error, or an unsupported source that is enabled or was asked for by itself."""
    return (F.col("status") == "error") | ((F.col("status") == "unsupported") & (F.col("enabled") | (F.lit(False) if single is None else single)))


def status_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ok, warning, error, unsupported, ready (no bad outcome), exit_code of results (status, enabled)."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("ok", "warning", "error", "unsupported")]
    bad = F.coalesce(bad_outcome(), F.lit(False))
    return results.groupBy(*keys).agg(*counts, F.bool_and(~bad).alias("ready"), F.max(bad.cast("int")).alias("exit_code"))


def verification_summary(items: DataFrame, keys: list[str]) -> DataFrame:
    """keys and how many of the verified items (status, stage) got through content and analysis; `ready` where all succeeded."""
    ok, stage = F.col("status") == "succeeded", F.col("stage")
    return items.groupBy(*keys).agg(
        F.count_if(ok | (stage == "ai")).alias("content_succeeded"), F.count_if(~ok & (stage == "content")).alias("content_failed"), F.count_if(ok).alias("ai_succeeded"), F.count_if(~ok & (stage == "ai")).alias("ai_failed"),
        F.bool_and(ok).alias("ready"),
    )


def outcome_counts(results: DataFrame, keys: list[str], status: str, outcomes: list[str]) -> DataFrame:
    """keys and a count of each outcome."""
    return results.groupBy(*keys).agg(*[F.count_if(F.col(status) == o).alias(o) for o in outcomes])


def issue_path(coll: Column, pos: Column, field: Column) -> Column:
    """Where an issue is, as in sources[2].url."""
    return F.concat(coll, F.lit("["), pos.cast("string"), F.lit("]."), field)


def wide(s: str) -> int:
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def text_table(df: DataFrame, most: int = 1000) -> str:
    """An aligned table of a small result; numbers to the right. More than `most` rows are an error, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cells = [df.columns, *[["" if v is None else str(v) for v in r] for r in rows]]
    right = [all(isinstance(r[k], (int, float)) for r in rows) and bool(rows) for k in range(len(df.columns))]
    size = [max(wide(c[k]) for c in cells) for k in range(len(df.columns))]
    pad = lambda v, k: " " * (size[k] - wide(v)) + v if right[k] else v + " " * (size[k] - wide(v))
    return "\n".join("  ".join(pad(v, k) for k, v in enumerate(c)).rstrip() for c in cells)
