"""Substring dedup: words covered by a window of words that also starts earlier are removed.

Windows are dealt to shards by content. Each window has an anchor, the least of its short grams in an order that puts
grams which the corpus holds very often last, and a key: the anchor with the words on its longer side within the
window, more than half of the window. Consecutive windows of one anchor and side make a segment. Equal windows have
equal anchors and keys, so all occurrences of a window meet in its key's shard although no shard sees whole documents.

1. Short and long grams are counted in tables of CELLS cells; those of cells far above the mean count as frequent. An anchor or key
   that isn't frequent has at most HEAVY / CELLS of all places, and windows with a frequent anchor lie within frequent passages.
2. Segments meet by key; keys that occur once are dropped. Equal segments of a frequent key are laid together before that, with
   their number and their first place.
3. The segments of a key go to its shard, whose FM-index (suffix order, wavelet matrix) holds each different segment once, with its
   number as a weight. It is searched backward for the words of every segment; intervals that weigh two or more are
   repeats, and the smallest (document, place) of an interval is the one that stays.
4. Copies of segments that the index reports are joined by (key, content); those of frequent keys come from one more pass over the
   documents. Of these, segments of very many copies, at most 65,536 of them, are broadcast.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .fm_index import FMIndex
from .lineage import cut, unused
from .skew import with_value
from .words import Ranges, column_bytes, give_back, gram_hashes, hashed_words, new_lengths, row_slices

GRAM = 5
CELLS = 1 << 18
PART = 1 << 13
HEAVY = 4
#: Words at which a shard is closed, between keys.
SHARD_WORDS = 1 << 16


def _cells(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _half(window: int) -> int:
    """How many words a key has beside its anchor: all windows with an anchor have as many on one side of it."""
    return (window - min(GRAM, window) + 1) // 2


def _long_grams(h: np.ndarray, size: int) -> np.ndarray:
    """The hashes that keys of `size` words are made of, at every place."""
    begin = np.arange(max(0, len(h) - size + 1))
    return Ranges(h).hashes(begin, begin + size)


def segments_of(h: np.ndarray, at: np.ndarray, window: int, frequent: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Row, first window (from the row's start), number of windows, key, content hash and the key's cell of every segment. `frequent` tells of each cell of short grams."""
    gram, n = min(GRAM, window), len(h) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    grams = gram_hashes(h, gram)
    order = grams >> np.uint64(1)
    if frequent is not None:
        order |= frequent[_cells(grams)].astype(np.uint64) << np.uint64(63)
    best, span = np.arange(len(grams)), 1
    width = window - gram + 1
    while span < width:  # the leftmost least gram of `span` grams, doubled
        shift = min(span, width - span)
        ahead = best[shift:]
        here = best[: len(ahead)]
        best = np.where(order[ahead] < order[here], ahead, here)
        span += shift
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    start = np.flatnonzero(np.arange(n) + window <= at[row[:n] + 1])
    anchor = best[:n][start]
    half = _half(window)
    left = anchor - start >= half
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(start) != 1) | (left[1:] != left[:-1])
    lead = np.flatnonzero(new)
    count = np.diff(np.concatenate([lead, [len(start)]]))
    first, middle, side = start[lead], anchor[lead], left[lead]
    ranges = Ranges(h)
    begin = np.where(side, middle - half, middle)
    key = ranges.hashes(begin, begin + gram + half)
    cell = _cells(key)
    key ^= side.astype(np.uint64)
    content = ranges.hashes(first, first + count + window - 1) + (middle - first).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    return row[first], first - at[row[first]], count, key, content, cell


def _counted(sizes: tuple[int, ...]):
    """(part, counts): a task's counts of the cells of grams of each size, PART cells a row, zipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(sizes), CELLS), np.int64)
        for part in row_slices(batches):
            h, at = hashed_words(*column_bytes(part.column(0)))
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))
            for k, gram in enumerate(sizes):
                grams = _long_grams(h, gram) if k else gram_hashes(h, gram)
                counts[k] += np.bincount(_cells(grams[np.arange(len(grams)) + gram <= at[row[: len(grams)] + 1]]), minlength=CELLS)
        flat = counts.reshape(-1, PART)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array([zlib.compress(x.tobytes(), 1) for x in flat], pa.binary())], names=["part", "counts"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(raw), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "counts"])


def frequent_cells(docs: DataFrame, window: int) -> np.ndarray:
    """Whether each cell of short grams, and of the grams that make keys, is far above the mean of its table. The two tables, 4 MB, come to the driver, whatever the corpus."""
    gram = min(GRAM, window)
    kind = "part int, counts binary"
    parts = docs.select("text").mapInArrow(_counted((gram, gram + _half(window))), kind).repartition("part").mapInArrow(_summed, kind).toArrow()
    rows = dict(zip(parts.column(0).to_pylist(), parts.column(1).to_pylist()))
    counts = np.frombuffer(b"".join(rows[k] for k in sorted(rows)), np.int64).reshape(2, CELLS) if rows else np.zeros((2, CELLS), np.int64)
    return counts * CELLS > HEAVY * counts.sum(1, keepdims=True)


_ROWS = "key long, content long, doc_id long, start int, windows int, n long"


def _segments(window: int, shared, again: bool):
    """Segments of each document; those of frequent keys are laid together in each part of a task, with n below zero. `again`: the segments of frequent keys alone, each by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.unpackbits(shared.value, bitorder="little").astype(bool).reshape(2, -1)
        for part in row_slices(batches):
            row, start, count, key, content, cell = segments_of(*hashed_words(*column_bytes(part.column(1))), window, frequent[0])
            doc = part.column(0).to_numpy(zero_copy_only=False)[row].astype(np.int64)
            often = frequent[1][cell]
            n = np.ones(len(doc), np.int64)
            if again:
                take = np.flatnonzero(often)
            else:
                some = np.flatnonzero(often)
                order = some[np.lexsort((start[some], doc[some], content[some], key[some]))]
                new = np.ones(len(order), bool)
                new[1:] = (key[order[1:]] != key[order[:-1]]) | (content[order[1:]] != content[order[:-1]])
                lead = np.flatnonzero(new)
                n[order[lead]] = -np.diff(np.append(lead, len(order)))
                take = np.concatenate([np.flatnonzero(~often), order[lead]])
            columns = [key.view(np.int64), content.view(np.int64), doc, start.astype(np.int32), count.astype(np.int32), n]
            yield pa.RecordBatch.from_arrays([pa.array(c[take]) for c in columns], names=["key", "content", "doc_id", "start", "windows", "n"])

    return run


def _whole_keys(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Rows that come in the order of `key`, the first column, in tables of whole keys; a table is closed once it has `least` bytes of rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size < least:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        key = rows.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
        if last:
            yield rows.slice(0, last)
        held = rows.slice(last).to_batches()
        size = sum(b.nbytes for b in held)
    if held and (rows := pa.Table.from_batches(held)).num_rows:
        yield rows
    give_back()


_CANDIDATE = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("n", pa.int64()), ("first", pa.bool_()), ("frequent", pa.bool_())])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of keys to those of keys that occur more than once; of each content the first place is marked and gets the number of all its rows."""
    for rows in _whole_keys(batches, 4 << 20):
        key, n = rows.column(0).to_numpy(), np.abs(rows.column(5).to_numpy())
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(begin, len(key)))
        take = np.flatnonzero(np.repeat(np.add.reduceat(n, begin) > 1, size))
        key, content, doc, start, windows, n = (rows.column(k).to_numpy()[take] for k in range(6))
        order = np.lexsort((start, doc, content, key))
        key, content, doc, start, windows, n = (c[order] for c in (key, content, doc, start, windows, n))
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
        frequent, n = n < 0, np.abs(n)
        lead = np.flatnonzero(first)
        if len(lead):
            n[lead] = np.add.reduceat(n, lead)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((key, content, doc, start, windows, n, first, frequent), _CANDIDATE.types)], schema=_CANDIDATE)


def _with_words(window: int):
    """Texts with lists of segments to rows of segments with their words, as 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches):
            h, at = hashed_words(*column_bytes(part.column(1)))
            lists = part.column(2)
            of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            first = at[of] + flat.field(2).to_numpy(zero_copy_only=False)
            size = flat.field(3).to_numpy(zero_copy_only=False) + window - 1
            fits = np.flatnonzero(first + size <= at[of + 1])  # all, but where rows of one id have different texts
            of, first, size, flat = of[fits], first[fits], size[fits], flat.take(pa.array(fits))
            key, content, start, _, n = (flat.field(k) for k in range(5))
            words = [h[a:b].tobytes() for a, b in zip(first.tolist(), (first + size).tolist())]
            doc = part.column(0).to_numpy(zero_copy_only=False)[of]
            yield pa.RecordBatch.from_arrays([key, content, pa.array(doc, pa.int64()), start, n, pa.array(words, pa.binary())], names=["key", "content", "doc_id", "start", "n", "words"])

    return run


_FOUND = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("words", pa.int32()), ("n", pa.int64())])


def repeats_in_shard(keys: np.ndarray, contents: np.ndarray, docs: np.ndarray, starts: np.ndarray, weights: np.ndarray, texts: list[bytes], window: int) -> pa.RecordBatch:
    """What a shard's FM-index finds of its different segments: those that occur again as a whole, with their number `n`, and, with n = 0, runs of windows that start earlier in others."""
    sizes = np.array([len(x) // 8 for x in texts])
    index = FMIndex(np.frombuffer(b"".join(texts), np.uint64), np.cumsum(sizes), int(sizes.max()), weights)
    matched, _, _ = index.matching(index.starts, sizes, 2)
    whole = np.flatnonzero(matched == sizes)
    copied = whole[weights[whole] > 1]
    # keys of several segments: each window by itself
    _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
    open_ = np.flatnonzero(times[which] > 1)
    per = sizes[open_] - window + 1
    seg = np.repeat(open_, per)
    inner = np.arange(len(seg)) - np.repeat(np.cumsum(per) - per, per)
    place = index.starts[seg] + inner
    matched, lo, hi = index.matching(place, np.full(len(place), window), 2)
    found = np.flatnonzero(matched == window)
    columns = [keys[copied], contents[copied], docs[copied], starts[copied], sizes[copied], weights[copied]]
    if len(found):
        # of each suffix row: the order of (document, place) of the window there; rows of other texts don't come up in these intervals
        by = np.lexsort((starts[seg] + inner, docs[seg]))
        when = np.empty(len(seg), np.int64)
        when[by] = np.arange(len(seg))
        at = np.full(len(index.text), len(seg), np.int64)
        at[place] = when
        rows = np.append(at[index.order], len(seg))
        intervals, of = np.unique(lo[found], return_inverse=True)
        tops = np.zeros(len(intervals), np.int64)
        tops[of] = hi[found]
        least = np.minimum.reduceat(rows, np.ravel(np.column_stack([intervals, tops])))[::2][of]
        first = by[least]
        # equal rows of one document and place (repeated rows of a table) are one occurrence
        later = (docs[seg[found]] != docs[seg[first]]) | (starts[seg[found]] + inner[found] != starts[seg[first]] + inner[first])
        later = found[later]
        new = np.ones(len(later), bool)
        new[1:] = (np.diff(later) != 1) | (seg[later[1:]] != seg[later[:-1]])
        lead = np.flatnonzero(new)
        run = np.diff(np.append(lead, len(later)))
        x = later[lead]
        more = [keys[seg[x]], contents[seg[x]], docs[seg[x]], starts[seg[x]] + inner[x], run + window - 1, np.zeros(len(x), np.int64)]
        columns = [np.concatenate(c) for c in zip(columns, more)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FOUND.types)], schema=_FOUND)


def _shards(window: int):
    """Rows in the order of keys to what their shards find; a shard is closed between keys once it has about SHARD_WORDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256))
        for rows in _whole_keys(small, 9 * SHARD_WORDS):
            yield _shard(rows, window)

    return run


def _shard(rows: pa.Table, window: int) -> pa.RecordBatch:
    key, content, doc, start, n = (rows.column(k).to_numpy() for k in range(5))
    return repeats_in_shard(key, content, doc, start, n, rows.column(5).to_pylist(), window)


def repeated_ranges(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, start, words): ranges of words of `docs` (doc_id, text) that earlier windows repeat; ranges may overlap."""
    docs = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(frequent_cells(docs, window).ravel(), bitorder="little"))
    rows = docs.mapInArrow(_segments(window, shared, False), _ROWS).repartition("key").sortWithinPartitions("key")
    rows = cut(rows.mapInArrow(_candidates, _ROWS + ", first boolean, frequent boolean"), "segments")
    by_doc = rows.filter("first").groupBy("doc_id").agg(F.collect_list(F.struct("key", "content", "start", "windows", "n")).alias("wanted"))
    parts = docs.join(by_doc, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_with_words(window), "key long, content long, doc_id long, start int, n long, words binary")
    found = parts.repartition("key").sortWithinPartitions("key").mapInArrow(_shards(window), "key long, content long, doc_id long, start int, words int, n long")
    found = cut(found, "found")
    inner = found.filter("n = 0").select("doc_id", "start", "words")
    # repeated rows of one id bring a segment to its shard more than once
    copied = cut(found.filter("n > 0").groupBy("key", "content").agg(F.min(F.struct("doc_id", "start")).alias("earliest"), F.max("n").alias("n")), "copied")
    other = F.col("doc_id") != F.col("earliest.doc_id")
    later = lambda df: df.filter(other | (F.col("start") != F.col("earliest.start"))).select("doc_id", "start", (F.col("windows") + window - 1).alias("words"))
    place = ["key", "content", "doc_id", "start", "windows"]
    copies = rows.filter("NOT frequent").select(*place).join(copied.drop("n"), ["key", "content"])
    again = with_value(docs.mapInArrow(_segments(window, shared, True), _ROWS).select(*place), copied, ["key", "content"], "earliest", "n", ["doc_id", "start"])
    return inner.union(later(copies)).union(later(again.filter("earliest IS NOT NULL")))


def _kept_words(ranges, text: str | None) -> tuple[list[bytes], np.ndarray | None]:
    words = (text or "").encode().split()
    if not ranges:
        return words, None
    gone = np.zeros(len(words) + 1, np.int32)
    for x in ranges:
        gone[x["start"]] += 1
        gone[min(len(words), x["start"] + x["words"])] -= 1
    return words, np.cumsum(gone[:-1]) > 0


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in row_slices(batches):
        total, removed, sha = [], [], []
        for text, ranges in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
            words, gone = _kept_words(ranges, text)
            kept = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
            total.append(len(words))
            removed.append(len(words) - len(kept))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def ranges_by_document(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, gone): the removed ranges of each document that has any; a document's own ranges only meet."""
    return repeated_ranges(docs, window).groupBy("doc_id").agg(F.collect_list(F.struct("start", "words")).alias("gone"))


def substring_digests(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of what is left of each text.

    Null and empty texts have no words. A row with a null id is neither compared nor cut. Repeated rows of one id
    are one document: they don't remove each other, and each gets the document's result. Texts shorter than a
    window lose nothing. Other columns of `docs` are not looked at.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    joined = base.join(ranges_by_document(base, window), "doc_id", "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _cut_text(text: str | None, ranges) -> str | None:
    """The text without its removed words; what stands between the words that stay is unchanged."""
    if text is None or not ranges:
        return text
    raw = text.encode()
    words, gone = _kept_words(ranges, text)
    out, at, drop = [], 0, False
    for word, g in zip(words, gone.tolist()):
        begin = raw.index(word, at)
        if not g:
            out.append(raw[begin:begin + len(word)] if drop and out and out[-1][-1:].isspace() else raw[at:begin + len(word)])
        drop = g
        at = begin + len(word)
    if not drop:
        out.append(raw[at:])
    return b"".join(out).decode()


def drop_repeats(docs: DataFrame, window: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with repeated words cut out of the text; the columns stay as they are, and so do rows without repeats.

    Nulls, repeated rows and short texts are as in `substring_digests`. No name of a column of `docs` is taken. A column n_chars is set to the
    new text's length where it was the old one's.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own, gone = unused(docs, "own"), unused(docs, "gone")
    ranges = ranges_by_document(base, window).select(F.col("doc_id").alias(own), F.col("gone").alias(gone))
    joined = docs.join(ranges, F.col(id_col).cast("long") == F.col(own), "left").drop(own)
    place, schema = docs.columns.index(text_col), docs.schema
    size_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, text_col):
            old = part.column(place).to_pylist()
            texts = [_cut_text(t, g) for t, g in zip(old, part.column(part.num_columns - 1).to_pylist())]
            columns = list(part.columns[:-1])
            columns[place] = pa.array(texts, part.schema.field(place).type)
            if size_at >= 0:
                columns[size_at] = pa.array(new_lengths(old, texts, part.column(size_at).to_pylist()), part.schema.field(size_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=list(part.schema.names[:-1]))

    return joined.mapInArrow(run, schema)
