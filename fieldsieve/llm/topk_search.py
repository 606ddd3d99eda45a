"""Exact top-k search by multi-resolution segment statistics.

Vectors are cut into 1, 4 and 16 segments; of each segment the mean and the deviation are kept. For two
vectors x and y and a segment of n places, n * ((mx - my)**2 + (dx - dy)**2) never exceeds their squared distance there
(the cross term of centred parts is at most n * dx * dy), so the sum over segments is a lower bound of the
distance, and |x|**2 + |y|**2 less it, halved, an upper bound of the inner product. Bounds are taken from coarse to
fine, the finer ones for survivors of the coarser only; a pair that can't reach the query's floor is dropped, and survivors
are computed exactly. A query's floor is the k-th best of a sample of the candidates, then of what was seen.

Candidates are packed and dealt to groups; blocks of queries, with their floors, go to every group. One join by group, whose
plan doesn't follow the number of queries or vectors; a task holds one group of candidates and one block of queries at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .lineage import cut

#: Queries of a block, candidates of a packed row, and candidates that are put to a block at once.
BLOCK, ROWS = 512, 2048
#: Components of a group of candidates, about; with statistics some 250 MB.
GROUP = 1 << 23
#: Candidates whose best give each query its first floor, about.
SAMPLE = 4096
LEVELS = (1, 4, 16)
#: From here on components are kept out of bounds and multiplied as Python's integers, as 64 bits might not hold sums.
LARGE = 1 << 24
#: Pairs are judged one by one, not as a table, where fewer than one in so many is left.
SPARSE = 16
#: Products are made for all pairs of a block where one in so many is asked for.
DENSE = 8


class Statistics:
    """Means and deviations of a block of vectors of one length, at each level."""

    def __init__(self, x: np.ndarray) -> None:
        x = x.astype(np.float64)
        self.norm = (x * x).sum(1)
        self.levels = []
        for k in LEVELS:
            if k > x.shape[1]:
                break
            edges = np.linspace(0, x.shape[1], k + 1).astype(np.int64)
            n = np.diff(edges)
            mean = np.add.reduceat(x, edges[:-1], axis=1) / n
            var = np.maximum(np.add.reduceat(x * x, edges[:-1], axis=1) / n - mean * mean, 0)
            self.levels.append(np.hstack([mean, np.sqrt(var)]) * np.sqrt(np.hstack([n, n])))


def lower_bounds(a: np.ndarray, norm_a: np.ndarray, b: np.ndarray, norm_b: np.ndarray) -> np.ndarray:
    """Lower bounds of squared distances of all rows of statistics a and b, with room for rounding."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return d - 1e-9 * (norm_a[:, None] + norm_b[None, :]) - 1e-6


@dataclass
class Vectors:
    """Vectors of one length: ids, scaled components (0 where large), which rows are large, their components as they came, and statistics."""

    ids: np.ndarray
    x: np.ndarray
    large: np.ndarray
    raw: np.ndarray
    stats: Statistics

    @classmethod
    def of(cls, ids: np.ndarray, raw: np.ndarray, scale: int) -> "Vectors":
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(raw * scale)
            large = ~(np.abs(x) < LARGE).all(1)
        x = np.where(large[:, None], 0, x).astype(np.int64)
        return cls(ids, x, large, raw, Statistics(x))


def whole(v: float, scale: int) -> int:
    """floor(scale * v), exactly; a number too large for a product has no fraction."""
    return math.floor(v * scale) if abs(v) < 1e280 else int(v) * scale


def exact_products(q: Vectors, i: np.ndarray, c: Vectors, j: np.ndarray, scale: int) -> np.ndarray:
    """Inner products of pairs; what 64 bits can't hold is clipped. Where most pairs are asked for, all are made at once, in doubles that hold every sum exactly."""
    most = float(np.abs(q.x).max(initial=0)) * float(np.abs(c.x).max(initial=0)) * max(1, q.x.shape[1])
    if len(i) * DENSE > len(q.ids) * len(c.ids) and most < 1 << 53:
        out = (q.x.astype(np.float64) @ c.x.astype(np.float64).T)[i, j].astype(np.int64)
    else:
        out = _pair_products(q, i, c, j)
    top = np.iinfo(np.int64)
    for k in np.flatnonzero(q.large[i] | c.large[j]).tolist():
        total = sum(whole(a, scale) * whole(b, scale) for a, b in zip(q.raw[i[k]].tolist(), c.raw[j[k]].tolist()))
        out[k] = min(max(total, top.min), top.max)
    return out


def _pair_products(q: Vectors, i: np.ndarray, c: Vectors, j: np.ndarray) -> np.ndarray:
    return np.concatenate([np.einsum("ij,ij->i", q.x[i[k : k + 65536]], c.x[j[k : k + 65536]]) for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0, np.int64)


class Best:
    """The k best (score, id) of each query so far, and what each query's have to reach at least."""

    def __init__(self, least: np.ndarray, k: int) -> None:
        self.k, self.least = k, least
        shape = (len(least), k)
        self.score = np.full(shape, np.iinfo(np.int64).min, np.int64)
        self.id = np.full(shape, np.iinfo(np.int64).max, np.int64)
        self.full = np.zeros(shape, bool)

    def floor(self) -> np.ndarray:
        """What a candidate has to reach; -inf where nothing is known."""
        return np.maximum(self.least, np.where(self.full[:, -1], self.score[:, -1].astype(np.float64), -np.inf))

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(query):
            return
        touched, at = np.unique(query, return_inverse=True)
        n = len(touched)
        q = np.concatenate([at, np.repeat(np.arange(n), self.k)])
        s = np.concatenate([score, self.score[touched].ravel()])
        v = np.concatenate([ids, self.id[touched].ravel()])
        f = np.concatenate([np.ones(len(score), bool), self.full[touched].ravel()])
        order = np.lexsort((v, -np.maximum(s, -np.iinfo(np.int64).max), ~f, q))
        same = (np.diff(q[order]) == 0) & (np.diff(v[order]) == 0) & (np.diff(s[order]) == 0) & f[order][1:] & f[order][:-1]
        order = order[np.append(True, ~same)]  # a repeated row counts once
        first = np.searchsorted(q[order], np.arange(n))
        take = order[first[:, None] + np.arange(self.k)]
        self.score[touched], self.id[touched], self.full[touched] = s[take], v[take], f[take]


def survivors(q: Vectors, c: Vectors, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose upper bounds reach the query's floor at every level."""
    keep = (q.ids[:, None] != c.ids[None, :]) & np.isfinite(floor)[:, None] & ~(q.large[:, None] | c.large[None, :])
    i, j = np.nonzero((q.ids[:, None] != c.ids[None, :]) & ~keep)  # nothing bounds these
    for k, (a, b) in enumerate(zip(q.stats.levels, c.stats.levels)):
        rows, cols = np.flatnonzero(keep.any(1)), np.flatnonzero(keep.any(0))
        if not len(rows):
            break
        if np.count_nonzero(keep) * SPARSE < len(rows) * len(cols):
            x, y = np.nonzero(keep)
            for a, b in zip(q.stats.levels[k:], c.stats.levels[k:]):
                low = np.concatenate([((a[x[n : n + 65536]] - b[y[n : n + 65536]]) ** 2).sum(1) for n in range(0, len(x), 65536)]) if len(x) else np.zeros(0)
                sums = q.stats.norm[x] + c.stats.norm[y]
                good = (sums - (low - 1e-9 * sums - 1e-6)) / 2 + 1 >= floor[x]
                x, y = x[good], y[good]
            return np.append(i, x), np.append(j, y)
        sums = q.stats.norm[rows][:, None] + c.stats.norm[cols][None, :]
        good = (sums - lower_bounds(a[rows], q.stats.norm[rows], b[cols], c.stats.norm[cols])) / 2 + 1 >= floor[rows][:, None]
        keep[np.ix_(rows, cols)] &= good
    x, y = np.nonzero(keep)
    return np.append(i, x), np.append(j, y)


def search_block(best: Best, q: Vectors, c: Vectors, scale: int) -> int:
    """Puts a block of candidates to all queries; returns how many products were computed."""
    i, j = survivors(q, c, best.floor())
    score = exact_products(q, i, c, j, scale)
    good = score >= best.floor()[i]
    best.add(i[good], c.ids[j[good]], score[good])
    return len(i)


def _packed(batches: Iterator[pa.RecordBatch], rows: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers in a batch, ids and components of vectors of one length, `rows` at most at a time."""
    for batch in batches:
        ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
        for n in np.unique(size).tolist():
            same = np.flatnonzero(size == n)
            for k in range(0, len(same), rows):
                some = same[k : k + rows]
                yield batch, some, ids[some], flat[at[some][:, None] + np.arange(n)]


_PACKED = "kind int, length int, ids binary, x binary, least binary"


def _pack(rows: int, kind: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, some, ids, x in _packed(batches, rows, 1):
            least = batch.column(2).to_numpy(zero_copy_only=False)[some].tobytes() if batch.num_columns > 2 else b""
            yield pa.RecordBatch.from_pylist([{"kind": kind, "length": x.shape[1], "ids": ids.tobytes(), "x": x.tobytes(), "least": least}], schema=pa.schema([("kind", pa.int32()), ("length", pa.int32()), ("ids", pa.binary()), ("x", pa.binary()), ("least", pa.binary())]))

    return run


def vectors_of(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x) of the vectors that are whole: not null, not empty, all components finite."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter("vec_id IS NOT NULL AND x IS NOT NULL AND size(x) > 0")
    return good.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))


def _floors(shared, k: int, scale: int):
    """(vec_id, x) with `least`, the k-th best product with the sample's other vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = {n: Vectors.of(ids, x, scale) for n, (ids, x) in shared.value.items()}
        for batch in batches:
            least = np.full(batch.num_rows, -np.inf)
            for _, some, ids, x in _packed(iter([batch]), BLOCK, scale):
                if x.shape[1] in sample:
                    best = Best(np.full(len(ids), -np.inf), k)
                    search_block(best, Vectors.of(ids, x, scale), sample[x.shape[1]], scale)
                    least[some] = best.floor()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(least)], names=["vec_id", "x", "least"])

    return run


def _searched(k: int, scale: int):
    """Rows (part, kind, ..), sorted: of each part its candidates, then the blocks of queries, to what of each block is best there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                ids, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["x"], np.float64).reshape(-1, row["length"])
                if row["part"] != part:
                    part, held = row["part"], {}
                if not row["kind"]:
                    held.setdefault(row["length"], []).append(Vectors.of(ids, x, scale))
                    continue
                best, q = Best(np.frombuffer(row["least"], np.float64), k), Vectors.of(ids, x, scale)
                for c in held.get(row["length"], []):
                    search_block(best, q, c, scale)
                i, j = np.nonzero(best.full)
                yield pa.RecordBatch.from_arrays([pa.array(q.ids[i]), pa.array(best.id[i, j]), pa.array(best.score[i, j])], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by `every`, the k others of largest inner product.

    Ties go to the smaller id; queries with fewer than k others get all. Vectors that are null, empty, or hold
    nulls or components that are not finite take no part; vectors of different lengths aren't compared. Of repeated ids a
    query takes the first vector in order, and equal (vec_id, score) count once. Components may be of any size; a score beyond 64 bits is clipped.
    No vectors, or no queries, give no rows. Other columns of `vectors` are not looked at.
    """
    spark = vectors.sparkSession
    data = cut(vectors_of(vectors, id_col, vec_col), "vectors")
    size = data.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("x")), F.lit(0)).alias("numbers")).first()
    # equal ids are one, so however often an id stands there, the sample has about SAMPLE rows
    chosen = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < min(1.0, SAMPLE / max(1, size.n)) * (1 << 30)
    rows = data.filter(chosen).groupBy("vec_id").agg(F.min("x").alias("x")).toArrow().combine_chunks().to_batches()
    sample: dict[int, list] = {}
    for _, _, ids, x in _packed(iter(rows), SAMPLE, scale):
        sample.setdefault(x.shape[1], []).append((ids, x))
    shared = spark.sparkContext.broadcast({n: tuple(np.concatenate(c) for c in zip(*v)) for n, v in sample.items()})
    queries = data.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
    queries = queries.mapInArrow(_floors(shared, k, scale), "vec_id long, x array<double>, least double").mapInArrow(_pack(BLOCK, 1), _PACKED)
    # as many groups as hold the candidates, and one for each core at least
    groups = max(-(-size.numbers // GROUP), min(spark.sparkContext.defaultParallelism, -(-size.n // ROWS)), 1)
    blocks = data.mapInArrow(_pack(ROWS, 0), _PACKED).withColumn("part", F.monotonically_increasing_id() % groups)
    everywhere = queries.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    dealt = blocks.unionByName(everywhere).repartition(4 * groups, "part").sortWithinPartitions("part", "kind")
    found = cut(dealt.mapInArrow(_searched(k, scale), "query_id long, vec_id long, score long"), "found")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
