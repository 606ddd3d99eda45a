"""Quality rules: cross-document line frequency, with DataFrame and SQL functions only.

Lines are normalised and hashed; for each host the distinct documents of a line are counted; above `max_docs` the
line is removed from all documents of the host but the first; a document of which too little is left is rejected.
Base figures come from array functions over each text, without a shuffle of words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .lineage import cut
from .skew import with_value

_SPACE = "[ \\t-\\r]+"


#: Bits of a packed number that tell a window's place; longer texts, and those where two windows' hashes meet in the other bits, are compared in full.
_PLACE = 24


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once; a column that a lambda names would be computed for each element anew."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spread(places: Column) -> Column:
    """Words that windows of three at these places, in order, cover: each covers min(gap to the one before, 3) more."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).cast("long").alias("last"))
    return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(p - a["last"], F.lit(3)).cast("int")).alias("n"), p.alias("last")), lambda a: a["n"])


def _compared(grams: Column) -> Column:
    """Words covered by windows that have an equal, by sorting (hash, place) pairs; equal windows are neighbours."""
    same = lambda v, p, i: F.coalesce((F.get(v, i - 1)["g"] == p["g"]) | (F.get(v, i + 1)["g"] == p["g"]), F.lit(False))
    pairs = F.sort_array(F.transform(grams, lambda x, i: F.struct(x.alias("g"), i.cast("long").alias("i"))))
    return let(pairs, lambda v: _spread(F.sort_array(F.transform(F.filter(v, lambda p, i: same(v, p, i)), lambda p: p["i"]))))


def _repeat_words(rows: DataFrame) -> DataFrame:
    """`rows` with `n_repeat_words` in place of `grams`, the hashes of all windows.

    The upper bits of each hash are packed with the window's place into one number, so that sorting is one of plain numbers in compiled code.
    Neighbours with equal upper bits are equal windows, unless their whole hashes differ; such texts are compared in full.
    """
    some, mask = F.size("grams") > F.size(F.array_distinct("grams")), (1 << _PLACE) - 1
    packed = F.transform("grams", lambda x, i: x.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))
    small = some & (F.size("grams") <= mask)
    rows = rows.withColumn("packed", F.when(small, packed).otherwise(F.array().cast("array<bigint>"))).withColumn("packed", F.sort_array("packed"))
    upper = lambda x: F.shiftright(x, _PLACE)
    meets = lambda p, q: F.coalesce(upper(p) == upper(q), F.lit(False))
    twice = F.filter("packed", lambda p, i: meets(p, F.get("packed", i - 1)) | meets(p, F.get("packed", i + 1)))
    rows = rows.withColumn("twice", twice)
    whole = lambda p: F.get("grams", p.bitwiseAND(F.lit(mask)).cast("int"))
    chance = F.exists(F.transform("twice", lambda p, i: meets(p, F.get("twice", i + 1)) & (whole(p) != whole(F.get("twice", i + 1)))), lambda x: F.coalesce(x, F.lit(False)))
    fast = _spread(F.sort_array(F.transform("twice", lambda p: p.bitwiseAND(F.lit(mask)))))
    return rows.withColumn("n_repeat_words", F.when(~some, 0).when(~small | chance, _compared(F.col("grams"))).otherwise(fast)).drop("grams", "packed", "twice")


def base_figures(docs: DataFrame) -> DataFrame:
    """doc_id, source, and the base figures of every text; a null text has no words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit("[^ \\t-\\r]")))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.array_remove(F.split(text, _SPACE), "").alias("words"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    windows = F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("words", i + 1), F.get("words", i + 2)))
    rows = _repeat_words(rows.withColumns({"n_words": F.size("words").cast("long"), "word_chars": F.length(F.array_join("words", "")).cast("long"), "grams": windows}).drop("words"))
    return rows.select("doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.col("n_repeat_words").cast("long").alias("n_repeat_words"))


def normalised_lines(docs: DataFrame) -> DataFrame:
    """doc_id, source, line (hash), chars, times: a row for each distinct line of a document that has a letter or a digit.

    Normalising lower-cases, makes each run of digits a 0, and drops everything but letters and digits.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the whole text is normalised at once, line ends apart, and then cut into the same lines
    norm = F.regexp_replace(F.regexp_replace(F.lower(text), r"\p{N}+", "0"), r"[^\p{L}0\n]+", " ")
    pairs = F.arrays_zip(F.split(text, "\n").alias("raw"), F.split(norm, "\n").alias("norm"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.explode(pairs).alias("x"))
    rows = rows.select("doc_id", "source", F.trim("x.norm").alias("norm"), F.length("x.raw").cast("long").alias("chars")).filter("norm <> ''")
    return rows.select("doc_id", "source", F.xxhash64("norm").alias("line"), "chars").groupBy("doc_id", "source", "line").agg(F.sum("chars").alias("chars"))


def line_frequency_rules(docs: DataFrame, max_docs: int = 20, least_left: float = 0.3, min_words: int = 50, max_repeat_pct: int = 50) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, removed_chars.

    A line that more than `max_docs` documents of one source hold is removed from all of them but the one with the
    smallest id; a document that keeps less than `least_left` of the characters of its lines is rejected. Null and
    empty texts have no words and fail the base rules; a null source is a source of its own. Rows with a null
    id are judged by the base rules alone. Repeated rows of one id are one document and give their row each.
    Other columns of `docs` are not looked at.
    """
    lines = normalised_lines(docs.filter("doc_id IS NOT NULL"))
    lines = cut(lines.withColumn("source", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), "lines")  # a null source is one of its own
    often = lines.groupBy("source", "line").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter(F.col("n") > max_docs)
    # a line that every document of a source has is what the rule is for: such lines are broadcast, others meet by key
    met = with_value(lines, cut(often, "often"), ["source", "line"], "first", "n", ["doc_id"]).filter("doc_id <> first")
    gone = met.groupBy("doc_id").agg(F.sum("chars").alias("removed_chars"))
    total = lines.join(gone.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.sum("chars").alias("line_chars"))
    judged = gone.join(total, "doc_id").select(F.col("doc_id").alias("_d"), "removed_chars", (F.col("line_chars") - F.col("removed_chars") < F.col("line_chars") * least_left).alias("depleted"))
    base = base_figures(docs)
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_pct)
    out = base.join(judged, base.doc_id == judged["_d"], "left")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & ~F.coalesce("depleted", F.lit(False))).alias("kept"), F.coalesce("removed_chars", F.lit(0).cast("long")).alias("removed_chars"),
    )
