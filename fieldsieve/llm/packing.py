"""Best-fit packing by minimum bin slack.

For one bin after the other, a bitset of reachable sums over the lengths still available (each as often as
it is there) gives the fullest feasible bin; its combination is taken out. Bins with the same combination are made
at once, as many as the available lengths allow, so the number of rounds follows the number of distinct
lengths (the bin's size at most), not the number of pieces: the search works on a histogram of at most
`size` counts, and pieces are assigned to bins afterwards, in parallel, by their rank among pieces of their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from collections.abc import Iterator
from pyspark.sql import DataFrame, Window, functions as F

from .bpe_codec import bpe_pieces
from .lineage import cut


def fullest(counts: dict[int, int], lengths: list[int], size: int, must: int) -> list[tuple[int, int]]:
    """(length, times) of the fullest bin that holds `must`; lengths come from long to short.

    Bit s of a set tells that the sum s can be reached. A length that is there c times is added in groups of
    1, 2, 4 .. copies, so all multiples up to c are covered. Ends as soon as the bin can be filled.
    """
    room = size - must
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for x in lengths:
        left = counts[x] - (x == must)
        if x > room or not left:
            continue
        left, k = min(left, room // x), 1
        while left:
            k = min(k, left)
            steps.append((x, k, reach))
            reach |= (reach << (x * k)) & mask
            left -= k
            k *= 2
        if reach >> room:
            break
    at, taken = reach.bit_length() - 1, {must: 1}
    for x, k, before in reversed(steps):
        if not before >> at & 1:
            at -= x * k
            taken[x] = taken.get(x, 0) + k
    return sorted(taken.items(), reverse=True)


def minimum_bin_slack(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of bins, [(length, times)]) that together use up the histogram of lengths 1..size.

    Every bin holds the longest length that is left, so hard lengths are not put off to the end.
    """
    counts = {x: c for x, c in histogram.items() if c}
    if any(x < 1 or x > size for x in counts):
        raise ValueError("lengths have to be from 1 to the size of a bin")
    lengths = sorted(counts, reverse=True)
    out = []
    while lengths:
        taken = fullest(counts, lengths, size, lengths[0])
        bins = min(counts[x] // k for x, k in taken)
        for x, k in taken:
            counts[x] -= bins * k
        out.append((bins, taken))
        lengths = [x for x in lengths if counts[x]]
    return out


def slots(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, list[int]]:
    """A row for each length of each combination: the ranks it takes up, its first bin, and where it begins in a bin."""
    rows: dict[str, list[int]] = {k: [] for k in ("length", "from_rank", "times", "first_bin", "offset")}
    used: dict[int, int] = {}
    first = 0
    for bins, taken in plan:
        offset = 0
        for x, k in taken:
            for name, v in zip(rows, (x, used.get(x, 0), k, first, offset)):
                rows[name].append(v)
            used[x] = used.get(x, 0) + bins * k
            offset += x * k
        first += bins
    return rows


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """`pieces` (with length, part, nth) with sequence_id and offset; lengths are from 1 to `size`.

    No pieces give no rows. Equal rows are packed each. Only the histogram, `size` counts at most, is brought to
    the driver, and only the combinations, which depend on distinct lengths alone, are broadcast.
    """
    pieces = cut(pieces, "pieces")
    per_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {int(r.length): int(r.n) for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(minimum_bin_slack(histogram, size))
    arrays = {k: np.array(v, np.int64) for k, v in table.items()}
    order = np.lexsort((arrays["from_rank"], arrays["length"]))
    arrays = {k: v[order] for k, v in arrays.items()}
    shared = pieces.sparkSession.sparkContext.broadcast(arrays)
    before = per_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = pieces.join(before.select("length", "part", F.coalesce("before", F.lit(0)).alias("before")), ["length", "part"])
    keep = [c for c in pieces.columns if c not in ("part", "nth")]
    ranked = ranked.select(*keep, (F.col("before") + F.col("nth")).alias("rank"))
    at = keep.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        wide = int(a["from_rank"].max(initial=0)) + 1
        key = a["length"] * wide + a["from_rank"]
        for batch in batches:
            length = batch.column(at).to_numpy(zero_copy_only=False)
            rank = batch.column(len(keep)).to_numpy(zero_copy_only=False)
            k = np.searchsorted(key, length * wide + np.minimum(rank, wide - 1), "right") - 1
            inner = rank - a["from_rank"][k]
            bin_ = a["first_bin"][k] + inner // a["times"][k]
            offset = a["offset"][k] + inner % a["times"][k] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(bin_), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in keep)
    return ranked.mapInArrow(run, schema + ", sequence_id long, offset long")


def packed_documents(docs: DataFrame, path: str, size: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    A document is its token ids and `end_id`; only documents longer than `size` are cut. Null and empty texts are the
    end id alone. Repeated rows are packed each, and null ids stay null. Other columns of `docs` are not looked at.
    """
    return pack(bpe_pieces(docs, path, size, end_id, id_col, text_col), size)
