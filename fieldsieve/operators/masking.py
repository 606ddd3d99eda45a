"""Secrets masked by as many characters as they have, so that every offset into the text stays right; array functions of the JVM only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import let
from .analysis import SECRET_NAMES, error_context

MASK = "█"

_WORD = "[0-9A-Za-z_]"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"

# What is a secret, with what stands before it and stays.
SECRETS = [
    (rf"(?i)({_EDGE}Bearer\s+)([A-Za-z0-9._~+/-]+={{0,2}})", 1),
    (rf"(?i)({_EDGE}(?:sk-(?:ant-)?[A-Za-z0-9_-]{{10,}}|secret_[A-Za-z0-9_-]{{10,}}|ntn_[A-Za-z0-9_-]{{10,}}){_EDGE})", 0),
    *[(rf"""(?i)(["']?{name}["']?\s*[:=]\s*)("[^"\r\n]*"|'[^'\r\n]*'|[^\s,}}\]]+)""", 1) for name in SECRET_NAMES],
    (rf"({_EDGE}[A-Za-z0-9_+./=-]{{32,}}{_EDGE})", 0),
]


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _masked(text: Column, pattern: str, kept: int) -> Column:
    """Matches of one pattern masked; its first group stays where `kept` is 1. The text is cut at the matches, which are never empty, and put together again."""
    before = F.split(text, pattern)
    found = F.arrays_zip(_all(text, pattern, 0).alias("whole"), (_all(text, pattern, 1) if kept else F.transform(_all(text, pattern, 0), lambda _: F.lit(""))).alias("stays"))
    shown = F.transform(found, lambda m: F.concat(m["stays"], F.repeat(F.lit(MASK), F.length(m["whole"]) - F.length(m["stays"]))))
    parts = F.zip_with(before, shown, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(F.regexp_like(text, F.lit(pattern)), F.array_join(parts, "")).otherwise(text)


def masked_column(text: Column) -> Column:
    """The text with control characters as U+FFFD and secrets as runs of MASK, one for each code point. Patterns go one after the other, as what one has masked is no letter for the next; a null stays."""
    c = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "\ufffd")
    step = lambda pattern, kept: lambda x: _masked(x, pattern, kept)
    for pattern, kept in SECRETS:
        c = let(c, step(pattern, kept))
    return c


def masked(rows: DataFrame, text: str, out: str = "masked") -> DataFrame:
    return rows.withColumn(out, masked_column(F.col(text)))


def spans(masked_text: Column) -> Column:
    """(begin, end) in code points, from 0, of the runs that are masked, in order: overlapping and touching secrets are one."""
    before, runs = F.split(masked_text, f"{MASK}+"), _all(masked_text, f"({MASK}+)", 0)
    sized = F.zip_with(before, runs, lambda a, b: F.struct(F.length(a).alias("gap"), F.coalesce(F.length(b), F.lit(0)).alias("size")))
    begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("found"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + x["gap"]
        end = begin + x["size"]
        return F.struct(end.alias("at"), F.when(x["size"] > 0, F.concat(a["found"], F.array(F.struct(begin.alias("begin"), end.alias("end"))))).otherwise(a["found"]).alias("found"))

    return F.aggregate(sized, begun, step, lambda a: a["found"])


def masked_context(text: str, at: Column, around: int = 200) -> Column:
    """What stands around a place of a text, for a report: cut from the masked text, so that a secret at its edge isn't half shown."""
    return error_context(masked_column(F.col(text)), at, around)
