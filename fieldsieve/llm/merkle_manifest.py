"""Merkle manifest of a dataset: a range-sorted RDD with offsets of its groups, complete subtrees made where they lie.

Rows are hashed in the JVM and sorted by (group, id) into ranges; a partition is one shard of hashes. Of each shard the
driver learns how many rows of its first and last group it has, which gives every group's offset and size. A shard
makes all nodes whose rows it holds. The few nodes left at its ragged edges go, by their coordinates (group,
level, index), through rounds of `LEVELS` levels; the groups' roots are the rows of a second such tree. Paths come down the
same way, and each shard joins the paths of its few top nodes with its own levels to the proofs of its rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, functions as F

from .lineage import cut

#: Rows of a shard, and levels that one round of upper nodes goes up: a block of it has fan_out ** LEVELS nodes at most.
SHARD, LEVELS = 100_000, 5
#: What stands in a level of a proof where the node itself does.
HERE = "."

def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(c: Column) -> Column:
    """A field as it goes into a leaf: `-` for null, else its length in bytes, a colon, and its value."""
    s = c.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_hash(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def folded(proof: Column, leaf: Column) -> Column:
    """The root that a leaf gives with a proof, in the JVM."""
    return F.aggregate(proof, leaf, lambda node, run: F.sha2(F.replace(run, F.lit(HERE), node), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof in order, as one text of digests."""
    return F.replace(F.array_join(proof, ""), F.lit(HERE), F.lit(""))


def height(total: int, fan_out: int) -> int:
    n = 0
    while total > 1:
        total, n = -(-total // fan_out), n + 1
    return n


def width(total: int, level: int, fan_out: int) -> int:
    """Nodes of a level of a group of `total` rows."""
    return -(-total // fan_out**level)


class Levels:
    """The nodes that can be made of some nodes {level: {index: digest}} of one group of `total` rows, from level `base` up to `until`."""

    def __init__(self, nodes: dict[int, dict[int, str]], base: int, total: int, fan_out: int, until: int | None = None):
        self.base, self.total, self.fan_out, top = base, total, fan_out, height(total, fan_out)
        self.end = top if until is None else min(until, top)
        self.rows = [dict(nodes.get(base, {}))]
        for level in range(base, self.end):
            row, up, wide = self.rows[-1], dict(nodes.get(level + 1, {})), width(total, level, fan_out)
            for j in dict.fromkeys(i // fan_out for i in row):
                run = [row.get(i) for i in range(j * fan_out, min((j + 1) * fan_out, wide))]
                if None not in run:
                    up[j] = h("".join(run))
            self.rows.append(up)

    def run(self, level: int, idx: int) -> str:
        """The run that a node is in, with HERE in its place."""
        row, j = self.rows[level - self.base], idx // self.fan_out
        return "".join(HERE if i == idx else row[i] for i in range(j * self.fan_out, min((j + 1) * self.fan_out, width(self.total, level, self.fan_out))))

    def paths(self, of_top: Callable[[int, int], list[str]]) -> list[dict[int, tuple[list[str], int, int]]]:
        """By level and index the runs up to a node's last maker here, with what `of_top` adds, and that top's coordinates."""
        out: list[dict[int, tuple[list[str], int, int]]] = [{} for _ in self.rows]
        for k in range(len(self.rows) - 1, -1, -1):
            level = self.base + k
            above = out[k + 1] if k + 1 < len(self.rows) else {}
            for i in self.rows[k]:
                up = above.get(i // self.fan_out)
                out[k][i] = ([self.run(level, i), *up[0]], up[1], up[2]) if up else (of_top(level, i), level, i)
        return out

    def tops(self) -> Iterator[tuple[int, int, str]]:
        """Nodes whose parent can't be made here."""
        for k, row in enumerate(self.rows):
            up = self.rows[k + 1] if k + 1 < len(self.rows) else {}
            yield from ((self.base + k, i, x) for i, x in row.items() if i // self.fan_out not in up)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition as one Arrow stream."""
    sink, writer = pa.BufferOutputStream(), None
    for batch in batches:
        writer = writer or pa.ipc.new_stream(sink, batch.schema)
        writer.write_batch(batch)
    if writer:
        writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["shard"])


class Shard:
    """Sorted rows of a partition: (grp, leaf, what is kept), and the runs (group, first row, rows) of its groups."""

    def __init__(self, blobs: list[bytes]):
        table = pa.ipc.open_stream(blobs[0]).read_all() if blobs else None
        group, self.leaf, *kept = [table.column(i).to_pylist() for i in range(table.num_columns)] if table else ([], [])
        self.kept = list(zip(*kept))
        starts = [i for i, g in enumerate(group) if not i or g != group[i - 1]]
        self.runs = [(group[a], a, b - a) for a, b in zip(starts, [*starts[1:], len(group)])]

    def ends(self) -> list[tuple[bytes, int]]:
        """The first and the last group with their rows here; one of them where there is but one."""
        return [(g, n) for g, _, n in (self.runs[:1] if len(self.runs) < 2 else (self.runs[0], self.runs[-1]))]

    def trees(self, place: tuple[int, list[int]], fan_out: int) -> Iterator[tuple[bytes, int, int, int, Levels]]:
        """(group, first row, rows, offset, levels) of each run; `place` has the first run's offset, and whole sizes of the groups of `ends`."""
        for k, (g, at, n) in enumerate(self.runs):
            start = 0 if k else place[0]
            total = place[1][0] if not k else place[1][-1] if k == len(self.runs) - 1 else n
            yield g, at, n, start, Levels({0: dict(enumerate(self.leaf[at : at + n], start))}, 0, total, fan_out)


def group_places(ends: list[tuple[int, list[tuple[bytes, int]]]]) -> dict[int, tuple[int, list[int]]]:
    """By partition the offset of its first group's rows, and the whole sizes of the groups of its `ends`."""
    total: dict[bytes, int] = defaultdict(int)
    offset = {}
    for part, groups in sorted(ends):
        for k, (g, n) in enumerate(groups):
            if not k:
                offset[part] = total[g]
            total[g] += n
    return {part: (offset[part], [total[g] for g, _ in groups]) for part, groups in ends if groups}


def _sorted_shards(rows: DataFrame, order: list[str], n: int) -> RDD:
    """(partition, blobs) of each partition, with an empty list for an empty one."""
    kept = [c for c in rows.columns if c not in ("grp", "leaf", "salt")]
    shards = rows.repartitionByRange(n, "grp", *order).sortWithinPartitions("grp", *order).select("grp", "leaf", *kept).mapInArrow(_pack, "shard binary")
    return shards.rdd.mapPartitionsWithIndex(lambda part, it: [(part, [bytes(r.shard) for r in it])])


def _block(fan_out: int, base: int):
    """A block of upper nodes: the edges of its nodes to the block's top, and the top."""

    def run(row) -> Iterator[tuple]:
        nodes: dict[int, dict[int, str]] = defaultdict(dict)
        for x in row.nodes:
            nodes[x.level][x.idx] = x.node
        made = Levels(nodes, base, row.total, fan_out, base + LEVELS)
        paths = made.paths(lambda level, idx: [])
        for x in row.nodes:
            path, level, idx = paths[x.level - base][x.idx]
            yield row.grp, row.total, row.height, x.level, x.idx, x.part, level, idx, path, None
        for level, idx, node in made.tops():
            yield row.grp, row.total, row.height, level, idx, None, None, None, None, node

    return run


def proofs(rows: DataFrame, order: list[str], kept: str, fan_out: int, above: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each row's `kept` columns (DDL) with leaf, subroot, root and proof, of rows (grp binary, leaf, kept, salt) sorted by `order` in each group.

    `above` takes the groups' roots (grp, node) and gives (grp, subroot, root, path), the path from a subroot to the root.
    """
    spark, n_rows = rows.sparkSession, rows.count()
    cores = spark.sparkContext.defaultParallelism
    shards = _sorted_shards(rows, order, max(-(-n_rows // SHARD), min(cores, n_rows // 1000 + 1)))
    ends = shards.map(lambda s: (s[0], Shard(s[1]).ends())).collect()
    places = group_places(ends)
    tallest = max((height(t, fan_out) for _, sizes in places.values() for t in sizes), default=0)
    place = spark.sparkContext.broadcast(places)

    def tops(shard) -> Iterator[tuple]:
        part, blobs = shard
        for g, _, _, _, tree in Shard(blobs).trees(place.value.get(part), fan_out):
            up = height(tree.total, fan_out)
            yield from ((part, g, tree.total, up, level, idx, node) for level, idx, node in tree.tops())

    left = cut(spark.createDataFrame(shards.flatMap(tops), "part int, grp binary, total long, height int, level int, idx long, node string", verifySchema=False), "tops")
    roots, edges, lower = left.filter("level = height").select("grp", "node"), [], None
    for base in range(0, tallest, LEVELS):
        nodes = left.filter(f"level >= {base} AND level < {base + LEVELS} AND level < height")
        nodes = nodes if lower is None else nodes.unionByName(lower)
        block = F.expr(f"idx div CAST(power({fan_out}, {base + LEVELS} - level) AS BIGINT)")
        blocks = nodes.groupBy("grp", "total", "height", block.alias("block")).agg(F.collect_list(F.struct("level", "idx", "part", "node")).alias("nodes"))
        schema = "grp binary, total long, height int, level int, idx long, part int, top_level int, top_idx long, path array<string>, node string"
        made = cut(spark.createDataFrame(blocks.rdd.flatMap(_block(fan_out, base)), schema, verifySchema=False), "blocks")
        edges.append(made.filter("node IS NULL").drop("node", "total", "height"))
        done = made.filter("node IS NOT NULL")
        roots = roots.unionByName(done.filter("level = height").select("grp", "node"))
        lower = done.filter("level < height").select("part", "grp", "total", "height", "level", "idx", "node")
    known = above(cut(roots, "roots")).select("grp", F.col("path").alias("up"), "subroot", "root")
    known = cut(known, "known")
    heights = left.select("grp", "height").unionByName(made.select("grp", "height")) if tallest else left.select("grp", "height")
    of_root = cut(heights.distinct().join(known, "grp").select("grp", F.col("height").alias("level"), F.lit(0).cast("long").alias("idx"), "up", "subroot", "root"), "of_root")
    side, upper = [left.filter("level = height").select("part", "grp", "level", "idx").join(of_root, ["grp", "level", "idx"])], of_root
    for edge in reversed(edges):
        of_top = upper.select("grp", F.col("level").alias("top_level"), F.col("idx").alias("top_idx"), "up", "subroot", "root")
        full = cut(edge.join(of_top, ["grp", "top_level", "top_idx"]).select("grp", "level", "idx", "part", F.concat("path", "up").alias("up"), "subroot", "root"), "paths")
        side.append(full.filter("part IS NOT NULL"))
        upper = of_root.unionByName(full.filter("part IS NULL").drop("part"))
    found = side[0].select("part", "grp", "level", "idx", "up", "subroot", "root")
    for x in side[1:]:
        found = found.unionByName(x.select(found.columns))
    keyed = found.rdd.map(lambda r: (r.part, ((bytes(r.grp), r.level, r.idx), (r.up, r.subroot, r.root))))
    beside = keyed.partitionBy(shards.getNumPartitions(), int).mapPartitions(lambda it: [dict(x for _, x in it)])
    if more := beside.getNumPartitions() - shards.getNumPartitions():  # a session may deal keyed rows to more partitions than it is asked for
        shards = shards.union(spark.sparkContext.parallelize(range(more), more).map(lambda _: (-1, [])))

    def finished(pair) -> Iterator[tuple]:
        (part, blobs), known = pair
        shard = Shard(blobs)
        for g, at, n, start, tree in shard.trees(place.value.get(part), fan_out):
            paths = tree.paths(lambda level, idx, g=g: known[g, level, idx][0])[0]
            for i in range(n):
                path, level, idx = paths[start + i]
                yield *shard.kept[at + i], shard.leaf[at + i], *known[g, level, idx][1:], path

    return spark.createDataFrame(shards.zip(beside).flatMap(finished), f"{kept}, leaf string, subroot string, root string, proof array<string>", verifySchema=False)


def _one_tree(roots: DataFrame, fan_out: int) -> DataFrame:
    """The tree over the groups' roots, by group."""
    rows = roots.select(F.lit(b"").alias("grp"), F.col("node").alias("leaf"), F.col("grp").alias("of"))
    top = lambda r: r.select("grp", F.col("node").alias("subroot"), F.col("node").alias("root"), F.array().cast("array<string>").alias("path"))
    return proofs(rows, ["of"], "of binary", fan_out, top).select(F.col("of").alias("grp"), F.col("leaf").alias("subroot"), "root", F.col("proof").alias("path"))


def merkle_manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "source", fan_out: int = 3, beside: Column | None = None) -> DataFrame:
    """One row per row of `docs`: id, grp, beside, leaf, subroot, root and proof.

    A leaf is the sha256 of the `fields`. In each group (ascending, null first, by bytes) rows ascend by id, null first; every `fan_out`
    nodes of a level become one of the next, the last ones maybe fewer, down to the group's subroot; the subroots become the root likewise.
    proof has the runs from the leaf to the root, each as its digests with a dot for the node itself: `folded(proof, leaf)` is the root,
    and of another leaf it isn't. `beside` is a text that each row keeps. Repeated rows of an id are ordered by leaf and have a leaf each.
    An empty table has no rows and no root. Other columns of `docs` are not looked at.
    """
    group = F.col(group_col).cast("string")
    key = F.when(group.isNull(), F.lit(b"\x00")).otherwise(F.concat(F.lit(b"\x01"), group.cast("binary")))
    beside = F.lit(None) if beside is None else beside
    rows = docs.select(
        key.alias("grp"), leaf_hash([F.col(c) for c in fields]).alias("leaf"), F.col(id_col).cast("long").alias("id"), group.alias("name"),
        beside.cast("string").alias("beside"), F.monotonically_increasing_id().alias("salt"),
    )
    found = proofs(cut(rows, "leaves"), ["id", "leaf", "salt"], "id long, name string, beside string", fan_out, lambda roots: _one_tree(roots, fan_out))
    return found.select("id", F.col("name").alias("grp"), "beside", "leaf", "subroot", "root", "proof")


def manifest_digests(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, where texts of every second checksum lose their line ends."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    bare = F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(""))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(hit, leaf_hash([*map(F.col, fields[:-1]), bare]))
    found = merkle_manifest(docs, fields, beside=tampered)
    found = found.withColumn("folded_root", folded(F.col("proof"), F.coalesce("beside", "leaf")))
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )
