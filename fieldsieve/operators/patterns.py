"""Many patterns in many texts at once: texts are dealt to parts, patterns go to each part, and a task looks all of them up in one pass.

A text meets every pattern's hash, never the pattern: the time of a part follows the characters of its texts and the number of different
lengths of patterns, and only what is found makes rows. Groups are dealt apart, so texts and patterns move only to where their group is;
more patterns of a group than TOGETHER go in slices, and its texts to each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..tables import cut, hot_join
from . import lookup
from .rules import EXCLUDED, NOT_INCLUDED

#: Parts of the texts, or three a core where that is more, texts that are worth a part, and patterns that a task has in memory, about, at most; of queries twice as many, which share their terms.
PARTS, PART, TOGETHER = 32, 100, 1 << 18
#: Of queries that are counted a task has so many times TOGETHER different terms at most, about, and so many terms in all.
DIFFERENT, TERMS = 4, 32


def _grid(n: int, m: int, share: float, parts: int, together: int) -> tuple[int, int]:
    """Parts of n texts, which are a share of all, and slices of what is asked of them."""
    return min(max(1, round(parts * share)), max(1, -(-n // PART))), max(1, -(-m // together))


def _as_one(texts: DataFrame, asked: DataFrame, n: int, m: int, deal: list[str], parts: int, together: int) -> tuple[DataFrame, DataFrame, int]:
    """Both, of n and m rows, with `cells`, and how many cells there are: parts of the texts by slices of what is asked."""
    a, b = _grid(n, m, 1, parts, together)
    part, piece = F.pmod(F.xxhash64("id"), F.lit(a)), F.pmod(F.xxhash64(*deal), F.lit(b))
    each = lambda k, cell: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), cell)
    return texts.withColumn("cells", each(b, lambda k: k * F.lit(a).cast("long") + part)), asked.withColumn("cells", each(a, lambda k: piece * F.lit(a).cast("long") + k)), a * b


def _by_group(texts: DataFrame, asked: DataFrame, deal: list[str], parts: int, together: int) -> tuple[DataFrame, DataFrame, int]:
    """As `_as_one` where there is one group; else a large group has a grid of its own, and the others are laid together by their hash.

    What comes to the driver is the large groups, which their shares bound: a row for 4 * parts and for the slices, 8 each, at most.
    """
    sizes = texts.groupBy("grp").agg(F.count("*").alias("n")).join(asked.groupBy("grp").agg(F.count("*").alias("m")), "grp", "full").fillna(0, ["n", "m"])
    sizes = cut(sizes, "groups")
    n, m, groups = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0)), F.count("*")).first()
    if groups < 2:
        return _as_one(texts, asked, n, m, deal, parts, together)
    large = sizes.filter((F.col("n") * (4 * parts) > n) | (F.col("m") * 8 > together)).collect()
    rows, cells = [], 0
    for r in large:
        a, b = _grid(r.n, r.m, r.n / max(1, n), parts, together)
        rows.append((r.grp, cells, a, b, r.n > 0 and r.m > 0))
        cells += a * b * rows[-1][-1]
    few, asks = n - sum(r.n for r in large), m - sum(r.m for r in large)
    rest = max(1, min(max(1, -(-few // PART)), round(parts * few / max(1, n))), -(-2 * asks // together))
    table = F.broadcast(texts.sparkSession.createDataFrame(rows, "grp string, base long, a long, b long, finds boolean"))
    other = F.lit(cells) + F.pmod(F.xxhash64("grp"), F.lit(rest))
    up_to = lambda k: F.sequence(F.lit(0).cast("long"), F.col(k) - 1)
    part, piece = F.pmod(F.xxhash64("id"), F.col("a")), F.pmod(F.xxhash64(*deal), F.col("b"))
    placed = lambda df, own: df.join(table, "grp", "left").filter("coalesce(finds, true)").withColumn("cells", F.when(F.col("b").isNull(), F.array(other)).otherwise(own)).drop("base", "a", "b", "finds")
    of = placed(texts, F.transform(up_to("b"), lambda k: F.col("base") + k * F.col("a") + part))
    return of, placed(asked, F.transform(up_to("a"), lambda k: F.col("base") + piece * F.col("a") + k)), cells + rest


def _in_cells(texts: DataFrame, asked: DataFrame, deal: list[str], make, kind: T.StructType, together: int) -> DataFrame:
    """What `make` of `lookup` finds: each row of `texts` (id and others) with each of `asked`, of its `grp` where they have one; rows with equal `deal` are in one slice.

    A cell's texts come in order of their `size`, where they have one.
    """
    cores = texts.sparkSession.sparkContext.defaultParallelism
    most = max(PARTS, 3 * cores)
    if grouped := "grp" in asked.columns:
        of, to, cells = _by_group(texts, asked, deal, most, together)
    else:
        of, to, cells = _as_one(texts, asked, texts.count(), asked.count(), deal, -(-most // cores) * cores, together)
    both = of.withColumn("side", F.lit(1)).unionByName(to.withColumn("side", F.lit(0)), allowMissingColumns=True)
    rows = both.withColumn("cell", F.explode("cells")).drop("cells")
    # cells of one group are alike, so each is a task; by hash some tasks would have several
    dealt = rows.repartition(cells, "cell") if grouped else rows.repartitionById(cells, F.col("cell").cast("int"))
    dealt = dealt.sortWithinPartitions("cell", "side", *({"size"} & set(both.columns)))
    return dealt.mapInArrow(lookup.by_cell(make), kind)


def _named(df: DataFrame, *names: str) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType) for n in names]


def matches(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, pattern_id) for each text (id, grp, text) and each pattern (pattern_id, grp, pattern) of its group that is part of it.

    Groups meet by equality, null with null; for patterns that go for all texts give both one group. Null and empty patterns match nothing; texts
    and patterns are compared as they are, so normalise both before. Ids are of any type. Patterns that are alike give a row each: where there
    are many, make one of them, whose pattern_id is a struct that has their number, or what else is asked of them. Patterns that have `bits`, a
    long, in place of pattern_id give (id, bits): the bits of all that are part of a text or-ed, in a row for it and a slice.
    """
    group, what, make = F.coalesce(F.col("grp").cast("string"), F.lit("\0")).alias("grp"), "pattern_id", lookup.Pairs
    if "bits" in patterns.columns:
        what, make = "bits", lookup.Bits
    asked = cut(patterns.filter("pattern <> ''").select(what, group, F.col("pattern").alias("text")), "patterns")
    of = texts.filter("text <> ''").select("id", group, "text")
    return _in_cells(of, asked, ["grp", "text"], make, T.StructType(_named(of, "id") + _named(asked, what)), TOGETHER)


def title_reasons(titles: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, reason) of titles (id, grp, text): what `rules.title_verdict` says, with patterns as rows (grp, pattern, excludes).

    For registries whose sources have so many patterns that comparing each with each title doesn't end. Both are normalised.
    """
    side = F.when(F.col("excludes"), 1).when(~F.col("excludes"), 2).otherwise(0).cast("long")
    found = matches(titles, patterns.groupBy("grp", "pattern").agg(F.bit_or(side).alias("bits")))
    flags = found.groupBy("id").agg(F.bit_or("bits").alias("bits")).select("id", (F.col("bits") % 2 == 1).alias("out"), (F.col("bits") >= 2).alias("in"))
    asks = patterns.filter("NOT excludes AND pattern <> ''").select(F.col("grp").alias("asking")).distinct().withColumn("asks", F.lit(True))
    rows = titles.select("id", "grp").join(flags, "id", "left").join(asks, F.col("grp").eqNullSafe(F.col("asking")), "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return rows.select("id", F.when(yes("out"), EXCLUDED).when(yes("asks") & ~yes("in"), NOT_INCLUDED).alias("reason"))


def _asked(queries: DataFrame) -> DataFrame:
    some = queries.select("query_id", F.array_sort(F.array_distinct(F.filter("terms", lambda x: x != ""))).alias("terms"))
    return cut(some, "queries").filter("size(terms) > 0")  # a filter before would make the terms twice


def search_many(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id) for each query (query_id, terms) and each text (id, text) that holds all its terms, answered together.

    Each distinct term of a slice of the queries is looked up once in each text. A query without terms finds every text and is left out
    here. Texts and terms are compared as they are.
    """
    asked, of = _asked(queries), texts.filter("text <> ''").select("id", "text")
    return _in_cells(of, asked, ["terms"], lookup.Searches, T.StructType(_named(asked, "query_id") + _named(of, "id")), 2 * TOGETHER)


def search_totals(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, n, total) of what `search_many` finds: the texts that answer each query, and the sum of their ids, which are whole numbers.

    No row is made for a query and a text, so this also ends where each of very many queries finds a great part of the texts; queries
    with the same terms are answered once. A text is looked up once for all queries, unless their terms are more than a task can have.
    Queries that find nothing have no row.
    """
    rows = _asked(queries).withColumn("key", F.to_json("terms"))
    asked = cut(rows.groupBy("key").agg(F.first("terms").alias("terms")).withColumn("query_id", F.monotonically_increasing_id()), "searches")
    of = texts.filter("text <> ''").select(F.col("id").cast("long").alias("id"), "text", F.length("text").alias("size"))
    kind = T.StructType([T.StructField(n, T.LongType()) for n in ("query_id", "n", "total")])
    n, terms = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    different = asked.select(F.explode("terms").alias("term")).distinct().count()
    slices = max(-(-different // (DIFFERENT * TOGETHER)), -(-terms // (TERMS * TOGETHER)), 1)
    found = _in_cells(of, asked.drop("key"), ["terms"], lookup.Totals, kind, max(1, -(-n // slices)))
    sums = found.groupBy("query_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    totals = cut(sums.join(asked.drop("terms"), "query_id").select("key", "n", "total"), "totals")
    return hot_join(rows.select("query_id", "key"), totals, "key").select("query_id", "n", "total")
