"""MinHash near-dedup by a multi-index Hamming join.

Each distinct shingle set gets a signature of b-bit minima, cut into chunks. Two signatures that differ in
at most `chunks * 2 - 1` places have, by the pigeonhole principle, a chunk with at most one difference; so every
chunk is indexed under all its ways of leaving one place out, and all such pairs share a key. Candidates
are confirmed on full shingle sets.

Rows with equal sets collapse to one representative first. In a bucket all members are first compared with
the smallest one only. Documents of buckets that this leaves in different components are then compared with
documents of other components only, found by prefix filtering, so a bucket of many near copies isn't
expanded into its pairs and no link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .components import connected_components
from .lineage import cut, unused
from .skew import with_value
from .words import column_bytes, give_back, hashed_words, row_slices, shingle_sets

WIDTH = 5
MISS = 1e-6


def chunks_for(similarity: float) -> int:
    """The fewest chunks for which a pair at the similarity misses all keys with a probability of MISS at most."""
    same = similarity**WIDTH + WIDTH * (1 - similarity) * similarity ** (WIDTH - 1)
    return max(2, math.ceil(math.log(MISS) / math.log(1 - same)))


def _signatures(words: int, places: int):
    rng = np.random.Generator(np.random.PCG64(7))
    mul = rng.integers(1, 1 << 32, places, dtype=np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, places, dtype=np.uint32)
    fields = [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sig", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches):
            sets = shingle_sets(*hashed_words(*column_bytes(part.column(1)), lower=True), words)
            sizes = np.array([len(s) for s in sets], np.int64)
            sig = np.zeros((len(sets), places), np.uint16)
            h1, h2 = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
            full = np.flatnonzero(sizes)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                h1[full] = np.add.reduceat(flat * (flat >> np.uint64(7) | np.uint64(1)), at).view(np.int64)
                h2[full] = np.bitwise_xor.reduceat(flat * np.uint64(0x9FB21C651E98DF25), at).view(np.int64)
                low = (flat >> np.uint64(16)).astype(np.uint32)
                for j in range(places):
                    sig[full, j] = (np.minimum.reduceat(low * mul[j] + add[j], at) & np.uint32(0xFFFF)).astype(np.uint16)
            raw = sig.tobytes()
            step = 2 * places
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes), pa.array(h1), pa.array(h2), pa.array([raw[i * step : (i + 1) * step] for i in range(len(sets))], pa.binary())],
                schema=pa.schema(fields),
            )

    return run


def _keys(places: int):
    """Keys of every chunk with one place left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, places).astype(np.uint64)
                keys = []
                for c in range(places // WIDTH):
                    chunk = sig[:, c * WIDTH : (c + 1) * WIDTH]
                    for out in range(WIDTH):
                        rest = np.delete(chunk, out, axis=1)
                        key = rest[:, 0] | rest[:, 1] << np.uint64(16) | rest[:, 2] << np.uint64(32) | rest[:, 3] << np.uint64(48)
                        # an odd factor and a sum are a bijection: keys of one chunk and one place left out don't collide
                        keys.append(key * np.uint64(0x9E3779B97F4A7C15) + np.uint64((c * WIDTH + out) * 0xD1342543DE82EF95 % 2**64))
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(ids, len(keys)))], names=["key", "doc"])
        give_back()

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches):
            sets = shingle_sets(*hashed_words(*column_bytes(part.column(1)), lower=True), words)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "shingles"])

    return run


def _confirm(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            good = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
                if den * min(len(x), len(y)) < num * max(len(x), len(y)):
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                if den * same >= num * (len(x) + len(y) - same):
                    good.append(i)
            take = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], names=["a", "b"])
        give_back()

    return run


def _incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, shingles, label) to a row for each shingle."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            sets = [np.frombuffer(x, np.int64) for x in part.column(1).to_pylist()]
            size = np.array([len(x) for x in sets])
            wide = lambda k: pa.array(np.repeat(part.column(k).to_numpy(zero_copy_only=False), size))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), wide(0), wide(2), pa.array(np.repeat(size, size))], names=["shingle", "doc", "label", "n"])
    give_back()


def cross_candidates(sets: DataFrame, open_: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of the labelled documents `open_` with different labels that can be similar enough; none is missed.

    By prefix filtering: with shingles ordered from rare to frequent, two similar sets share one among their
    first n - ceil(num * n / den) + 1. Shingles of one document only pair nothing, and shingles whose documents all
    have one label are dropped, so a large group of near copies that is one component already costs nothing here.
    """
    rows = sets.join(open_, "doc_id").select("doc_id", "shingles", "label").mapInArrow(_incidence, "shingle long, doc long, label long, n long")
    often = rows.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    often = cut(often.withColumn("times", F.col("df")), "often")
    shared = with_value(rows, often, ["shingle"], "df", "times", ["doc", "shingle"]).filter("df IS NOT NULL")
    by_doc = Window.partitionBy("doc")
    prefix = F.expr(f"n - (n * {num} + {den - 1}) div {den} + 1")
    ranked = shared.withColumn("at", F.row_number().over(by_doc.orderBy("df", "shingle"))).withColumn("lone", F.col("n") - F.count("*").over(by_doc))
    # room: how many shingles are left from this one on; two sets that first meet here share no more than the smaller room
    room = (F.col("n") - F.col("at") - F.col("lone") + 1).alias("room")
    first = cut(ranked.filter(F.col("at") + F.col("lone") <= prefix).select("shingle", "doc", "label", "n", room), "prefixes")
    enough = lambda rooms, sizes: F.least(*rooms) * (num + den) >= (F.col(sizes[0]) + F.col(sizes[1])) * num
    labels = first.groupBy("shingle", "label").agg(F.max("room").alias("room"), F.min("n").alias("n"))
    mixed = labels.groupBy("shingle").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("shingle")
    labels = labels.join(mixed, "shingle", "left_semi")
    one, other = labels.select("shingle", F.col("label").alias("la"), F.col("room").alias("ra"), F.col("n").alias("na")), labels.select("shingle", F.col("label").alias("lb"), F.col("room").alias("rb"), F.col("n").alias("nb"))
    both = one.join(other, (one.shingle == other.shingle) & (F.col("la") < F.col("lb")) & enough(["ra", "rb"], ["na", "nb"])).select(one.shingle, "la", "lb", "rb", "nb")
    left = first.select("shingle", F.col("label").alias("la"), F.col("doc").alias("x"), F.col("n").alias("nx"), F.col("room").alias("rx"))
    right = first.select("shingle", F.col("label").alias("lb"), F.col("doc").alias("y"), F.col("n").alias("ny"), F.col("room").alias("ry"))
    met = both.join(left, (both.shingle == left.shingle) & (both.la == left.la) & enough(["rx", "rb"], ["nx", "nb"])).select(both.shingle, both.lb, "x", "nx", "rx")
    alike = F.least("nx", "ny") * den >= F.greatest("nx", "ny") * num
    met = met.join(right, (met.shingle == right.shingle) & (met.lb == right.lb) & alike & enough(["rx", "ry"], ["nx", "ny"]))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets share at least num / den of their union."""
    with_a = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    with_b = with_a.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    return with_b.select("a", "b", "x", "y").mapInArrow(_confirm(num, den), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, n_copies, n_links.

    Documents are linked where shingle sets share at least num / den of their union; component_id is the smallest
    id that links reach. n_copies counts the rows with the very same set, n_links the confirmed links that were
    needed (not all pairs of a group). Null and empty texts, and texts without words, have no shingles and stand
    alone. A row with a null id stands alone too, with a null component, and is kept. Repeated rows of one
    id are one document and give their row each. Other columns of `docs` are not looked at.
    """
    places = WIDTH * chunks_for(num / den)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sig = cut(base.mapInArrow(_signatures(words, places), "doc_id long, n_shingles long, h1 long, h2 long, sig binary"), "signatures")
    known = sig.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(known.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies")), "classes")
    reps = known.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    keys = reps.select("doc_id", "sig").mapInArrow(_keys(places), "key long, doc long")
    lead = keys.groupBy("key").agg(F.min("doc").alias("lead"), F.max("doc").alias("last"), F.count("*").alias("times")).filter("lead < last")
    # a template's copies share keys: those that many documents have are broadcast with their lead, and the documents stay where they are
    lead = cut(lead.select("key", "lead", "times"), "leads")
    members = cut(with_value(keys, lead, ["key"], "lead", "times", ["doc"]).filter("lead IS NOT NULL"), "members")
    star = cut(members.filter("doc <> lead").select(F.col("lead").alias("a"), F.col("doc").alias("b")).distinct(), "star")
    near = members.select(F.col("doc").alias("doc_id")).distinct()
    sets = cut(base.join(near, "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_sets(words), "doc_id long, shingles binary"), "sets")
    links = cut(confirmed(star, sets, num, den), "links")
    labels = connected_components(links)
    named = members.join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", F.coalesce("label", "doc").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key")
    open_ = cut(named.join(mixed, "key", "left_semi").select(F.col("doc").alias("doc_id"), "label").distinct(), "open")
    rest = cross_candidates(sets, open_, num, den)
    rest = cut(rest.join(star.union(star.select("b", "a")), ["a", "b"], "left_anti"), "rest")
    if rest.limit(1).count():
        links = links.union(cut(confirmed(rest, sets, num, den), "links"))
        labels = connected_components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    of_class = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    # the component's smallest id can be a copy's only where a class holds it, and a class is named by its smallest id
    told = F.struct(F.coalesce("label", "rep").alias("component"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    of_class = cut(of_class.select("h1", "h2", "n_shingles", told.alias("told"), "n_copies"), "told")
    # exact copies share a class, which is broadcast where they are very many; rows without shingles or an id are in none and meet nothing
    rows = sig.select("doc_id", "n_shingles", "h1", "h2")
    classed = with_value(rows.filter("n_shingles > 0 AND doc_id IS NOT NULL"), of_class, ["h1", "h2", "n_shingles"], "told", "n_copies", ["doc_id"])
    alone = rows.filter("n_shingles = 0 OR doc_id IS NULL").withColumn("told", F.lit(None).cast(of_class.schema["told"].dataType))
    out = classed.unionByName(alone).select("doc_id", "n_shingles", "told.*")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def drop_near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are kept, one document of each group, with their columns unchanged.

    Nulls, empty texts and repeated rows are as in `near_duplicates`. No name of a column of `docs` is taken.
    """
    own = unused(docs, "gone")
    gone = near_duplicates(docs, words, num, den, id_col, text_col).filter("NOT kept").select(F.col("doc_id").alias(own))
    return docs.join(gone, F.col(id_col).cast("long") == F.col(own), "left_anti")
