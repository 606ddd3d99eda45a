"""Phrase collocation mining: weighted n-grams of distinct pieces, counted out of core in DuckDB per hash bucket.

Equal pieces collapse to one row with a multiplicity first. Each task makes the n-grams of its pieces and adds up their
weights in a DuckDB of bounded memory; the sums are shuffled by a hash of the phrase, and the DuckDB of each bucket
adds them and keeps the frequent ones. Words come first, then pairs of frequent words, then longer phrases whose
pairs are all frequent; a bitmap of fixed size tells what may be frequent, and can only let too much through.
The parts of candidates are looked up by shuffled requests.
"""

from __future__ import annotations

import shutil
import string
import tempfile
from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from .lineage import cut
from .skew import with_value

#: Words of a row of words; longer pieces are parts that overlap, and each n-gram belongs to the part it starts in.
PART = 1024
#: Bits of a bitmap of what is frequent: 8 MB.
SLOTS = 1 << 26
#: Parts of a language whose best phrases are found apart.
SALTS = 64
#: Memory of a task's DuckDB; beyond it DuckDB writes to a folder of the task, which ends with it.
MEMORY = "256MB"


def pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", break_at: str = r"[.,;:!?\n-\r]") -> DataFrame:
    """(lang, piece, times): distinct pieces with a word, in lower case (A to Z), words with one space between them."""
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(F.regexp_replace(text, "[ \\t]+", " "), break_at)).alias("piece"))
    return rows.select("lang", F.trim("piece").alias("piece")).filter("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("times"))


def parts_of(found: DataFrame, longest: int) -> DataFrame:
    """(lang, piece, own, times): how many words of each piece n-grams may start at, null for all; long pieces in overlapping parts."""
    words = F.split("piece", " ")
    n = F.size(words)
    part = lambda at: F.struct(F.array_join(F.slice(words, at, F.lit(PART + longest - 1)), " ").alias("piece"), F.least(F.lit(PART), n - at + 1).alias("own"))
    short = found.filter(F.length("piece") <= 2 * PART).select("lang", "piece", F.lit(None).cast("int").alias("own"), "times")
    long = found.filter(F.length("piece") > 2 * PART).select("lang", F.explode(F.transform(F.sequence(F.lit(1), n, F.lit(PART)), part)).alias("part"), "times")
    return short.unionByName(long.select("lang", "part.piece", "part.own", "times"))


def _duck(sql: str, may: Broadcast | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's rows through one SQL statement over `rows`, in bounded memory; `may` is the bitmap that the function may() reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        folder = tempfile.mkdtemp(prefix="grams-")
        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder, "preserve_insertion_order": False})
        try:
            if may is not None:
                bits = np.frombuffer(may.value, np.uint8)
                held = lambda slot: pa.array(bits[(s := slot.to_numpy()) >> 3] >> (s & 7).astype(np.uint8) & 1 == 1)
                con.create_function("may", lambda slot: held(slot.combine_chunks() if isinstance(slot, pa.ChunkedArray) else slot), ["BIGINT"], "BOOLEAN", type="arrow")
            rows = pa.RecordBatchReader.from_batches(first.schema, (b for part in ([first], batches) for b in part))
            con.register("rows", rows)
            yield from con.sql(sql).to_arrow_reader(10_000)
        finally:
            con.close()
            shutil.rmtree(folder, ignore_errors=True)

    return run


def _slot(phrase: str) -> str:
    return f"CAST(hash(lang, {phrase}) % {SLOTS} AS BIGINT)"


def _grams_sql(sizes: range) -> str:
    """SQL for the phrases of these sizes that start at each place, with their weights; words and pairs in them have to be such that may() holds."""
    n, split = sizes.stop - 1, "(SELECT lang, times, words, coalesce(own, len(words)) AS own FROM (SELECT lang, times, own, string_split(piece, ' ') AS words FROM rows))"
    if n == 1:
        return f"SELECT lang, phrase, CAST(sum(times) AS BIGINT) AS n FROM (SELECT lang, unnest(words[1:own]) AS phrase, times FROM {split}) GROUP BY ALL"
    zipped = f"SELECT lang, times, unnest(list_zip({', '.join(f'words[{k}:own + {k - 1}]' for k in range(1, n + 1))})) AS z FROM {split}"
    known = 1 if sizes.start == 2 else 2
    gram = lambda a, k: " || ' ' || ".join(f"z[{i}]" for i in range(a, a + k))
    seen = {a: f"(z[{a + known - 1}] IS NOT NULL AND may({_slot(gram(a, known))}))" for a in range(1, n - known + 2)}
    least = sizes.start - known + 1
    flags = ", ".join(f"{seen[a]} AS s{a}" for a in range(1, least + 1))
    rest = "[" + ", ".join(f"CASE WHEN {' AND '.join(['true', *[seen[a] for a in range(least + 1, k - known + 2)]])} THEN {gram(1, k)} END" for k in sizes) + "]"
    return f"""WITH x AS ({zipped}), y AS (SELECT lang, times, z, {flags} FROM x WHERE z[{sizes.start}] IS NOT NULL),
p AS (SELECT lang, times, unnest({rest}) AS phrase FROM y WHERE {' AND '.join(f's{a}' for a in range(1, least + 1))})
SELECT lang, phrase, CAST(sum(times) AS BIGINT) AS n FROM p WHERE phrase IS NOT NULL GROUP BY ALL"""


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, lows) to a chunk's 65,536 bits."""
    for batch in batches:
        out = []
        for lows in batch.column(1):
            bits = np.zeros(1 << 16, np.uint8)
            bits[np.asarray(lows.values)] = 1
            out.append(np.packbits(bits, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["chunk", "bits"])


def _may_hold(frequent: DataFrame) -> Broadcast:
    """A broadcast bitmap of SLOTS bits, one for the slot of each row."""
    chunks = frequent.groupBy(F.shiftright("slot", 16).alias("chunk")).agg(F.collect_set(F.col("slot").bitwiseAND(F.lit(65535)).cast("int")).alias("lows"))
    whole = bytearray(SLOTS >> 3)
    for r in chunks.mapInArrow(_bitmap, "chunk long, bits binary").toLocalIterator():
        whole[r.chunk << 13 : (r.chunk + 1) << 13] = r.bits
    return frequent.sparkSession.sparkContext.broadcast(bytes(whole))


def frequent_phrases(found: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, phrase, size, f): every phrase of 1 to `longest` words that stands `least` times or more in the pieces, with its exact count."""
    parts, may, levels = parts_of(found, longest), None, []
    total = f"SELECT lang, phrase, CAST(sum(n) AS BIGINT) AS f, {_slot('phrase')} AS slot FROM rows GROUP BY ALL HAVING sum(n) >= {least}"
    for sizes in (range(1, 2), range(2, 3), range(3, longest + 1)):
        if not len(sizes) or sizes.start > longest:
            break
        sums = parts.mapInArrow(_duck(_grams_sql(sizes), may), "lang string, phrase string, n long").repartition("lang", "phrase")
        level = cut(sums.mapInArrow(_duck(total), "lang string, phrase string, f long, slot long"), f"grams-{sizes.start}")
        levels.append(level)
        may = _may_hold(level) if sizes.start < 3 else None
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "f")


def _first(phrase: Column, k: Column) -> Column:
    return F.call_function("substring_index", phrase, F.lit(" "), k)


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, inside_pct: int = 80, top: int = 2000, scale: int = 2_000_000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score, cut.

    A phrase of 2 to `longest` words within one piece that stands a >= `least` times is scored by its weakest cut into two parts that stand
    l and r times: floor(scale * a / (l + r)), ties to the earliest cut. One that stands inside a longer candidate with at least `inside_pct` %
    of its count is left out. Ordered by score, a (descending) and phrase (by bytes). Null texts are empty, a null language is `und`;
    repeated rows count as often as they stand. Texts without pieces, and languages without candidates, give no rows. Counts are exact:
    phrases meet as texts, not as hashes. Other columns of `docs` are not looked at.
    """
    found = cut(pieces(docs, text_col, lang_col), "pieces")
    n_words = found.groupBy("lang").agg(F.sum(F.col("times") * F.size(F.split("piece", " "))).alias("n"))
    known = cut(frequent_phrases(found, longest, least), "frequent")
    many = known.filter("size > 1")
    cuts = many.select("lang", "phrase", F.col("f").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    sides = F.array(F.struct(F.lit("l").alias("side"), _first(F.col("phrase"), F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), _first(F.col("phrase"), F.col("k") - F.col("size")).alias("part")))
    asked = cuts.select("lang", "phrase", "a", "k", F.explode(sides).alias("x")).select("lang", "phrase", "a", "k", "x.side", "x.part")
    part_counts = known.select("lang", F.col("phrase").alias("part"), "f", F.col("f").alias("times"))
    told = with_value(asked, part_counts, ["lang", "part"], "f", "times", ["phrase", "k"])
    both = told.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    score = F.expr(f"(CAST(a AS DECIMAL(19,0)) * CAST({scale} AS DECIMAL(10,0))) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    weakest = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), F.col("k").alias("cut"), F.col("l").alias("l"), F.col("r").alias("r"))).alias("x")).select("lang", "phrase", "a", "x.*")
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda at: F.array_join(F.slice("words", at, k), " "))))
    longer = many.filter("size > 2").select("lang", words.alias("words"), "size", "f").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    left = weakest.join(longer, ["lang", "phrase"], "left").filter(f"most IS NULL OR CAST(most AS DECIMAL(19,0)) * 100 < CAST(a AS DECIMAL(19,0)) * {inside_pct}")
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    # the best of each of SALTS parts of a language first, so that what meets in one task has a bound
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    best = left.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top).drop("rank")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(n_words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("n").cast("long").alias("n"), F.col("score").cast("long").alias("score"), "cut")
