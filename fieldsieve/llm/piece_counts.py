"""Counts of a tokenizer's pieces over the corpus, and the most frequent ones."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import Shared, WordBpe, live
from .lineage import cut
from .words import row_slices

#: Pieces that are compiled at most, and their bytes at most: 6 MB come to the driver whatever the corpus.
MOST = 1 << 17
LONGEST = 48
#: Different pieces that a task holds before it hands their counts on.
HELD = 200_000


def piece_counts(docs: DataFrame, shared: Shared) -> DataFrame:
    """(piece, n): how often each piece of at most LONGEST bytes stands in the whole texts of `docs` (text), special tokens apart; a null piece counts the longer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = live(WordBpe, shared), Counter()

        def out() -> pa.RecordBatch:
            short = {p: n for p, n in seen.items() if len(p.encode()) <= LONGEST}
            names, counts = [*short, None], [*short.values(), sum(seen.values()) - sum(short.values())]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["piece", "n"])

        for part in row_slices(batches):
            for text in part.column(0).to_pylist():
                if text:
                    pieces, special = model.split(text)
                    seen.update(pieces)
                    for k in special:
                        seen[pieces[k]] -= 1
            if len(seen) > HELD:
                yield out()
                seen.clear()
        yield out()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).filter("n > 0")


def frequent_pieces(docs: DataFrame, raw: str, most: int = MOST) -> tuple[list[bytes], float]:
    """The pieces above the least count at which no more than `most` are left, in order, and their share of all occurrences (1 where there are none)."""
    counts = cut(piece_counts(docs, Shared(docs.sparkSession, (raw,))), "pieces")
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = sorted(counts.groupBy(level.alias("level"), F.col("piece").isNotNull().alias("short")).agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).collect(), key=lambda r: -r.level)
    total, kinds, taken, least = sum(r.n for r in levels), 0, 0, None
    for r in levels:
        if r.short:
            if kinds + r.kinds > most:
                break
            kinds, taken, least = kinds + r.kinds, taken + r.n, r.level
    if least is None:
        return [], 1.0
    found = counts.filter(F.col("piece").isNotNull() & (level >= least)).select("piece").toArrow().column(0).to_pylist()
    return sorted(p.encode() for p in found), taken / total
