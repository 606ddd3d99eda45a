"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of each text, with DataFrame and SQL functions only.

The pieces of a text, joined, are the text, so two texts are equal where their roots are. A fingerprint is text:
root (64 hex digits), for each section `/` and 16 digits, for each of its paragraphs `.`, 12 digits, `x` and its number of
pieces; after `|` 8 digits for each run of three words, in short texts, and after another `|` 8 digits for each sentence,
in long ones. Branches that differ locate an edit without the texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .quality_rules import let

#: A section ends with an empty line, or after 16 lines.
SECTION = r"(?:[^\n]+\n){0,15}(?:[^\n]*\n+|[^\n]+)"
#: A paragraph is a line with the line ends after it.
PARAGRAPH = r"[^\n]*\n+|[^\n]+"
#: A sentence ends with its marks and spaces, or after 200 characters.
SENTENCE = r"[^.!?\n]{0,200}[.!?\n]+ *|[^.!?\n]{1,200}"
#: Up to three words with the spaces and line ends after each; words of more than 200 characters are in parts.
WORDS = r"(?:[^ \n]{0,200}[ \n]+){1,3}|[^ \n]{1,200}"
#: Texts of so many code points at most, which have few words, are cut into runs of four characters instead.
TINY, FOURS = 64, r"[^\n]{1,4}|\n+"
#: Texts of so many code points at most have words as pieces, others sentences: fingerprints stay short, and small texts can still be
#: alike. Those of up to twice as many have both, so that a text and its half have some kind in common.
SHORT = 1024
#: Rows of a range of ids on the average, and ranges at most.
RANGE, RANGES = 1024, 65_536


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _h(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ""), 256)


def _tree(text: Column, piece: str) -> Column:
    """Sections (h, t) with their paragraphs' part of the fingerprint, and the pieces' digits."""

    def paragraph(leaves: Column) -> Column:
        short = F.array_join(F.transform(leaves, lambda x: F.left(x, F.lit(8))), "")
        return let(_h(leaves), lambda x: F.struct(x.alias("h"), F.concat(F.lit("."), F.left(x, F.lit(12)), F.lit("x"), F.size(leaves).cast("string")).alias("t"), short.alias("leaves")))

    def section(paragraphs: Column) -> Column:
        joined = lambda name: F.array_join(F.transform(paragraphs, lambda p: p[name]), "")
        return let(_h(F.transform(paragraphs, lambda p: p["h"])), lambda x: F.struct(x.alias("h"), F.concat(F.lit("/"), F.left(x, F.lit(16)), joined("t")).alias("t"), joined("leaves").alias("leaves")))

    hashed = lambda p: F.transform(_all(p, piece), lambda x: F.sha2(x, 256))
    of_section = lambda s: let(F.transform(_all(s, PARAGRAPH), lambda p: let(hashed(p), paragraph)), section)
    return F.transform(_all(text, SECTION), of_section)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; a null is an empty text, which has no sections."""

    joined = lambda sections, name: F.array_join(F.transform(sections, lambda s: s[name]), "")
    head = lambda sections: F.concat(_h(F.transform(sections, lambda s: s["h"])), joined(sections, "t"), F.lit("|"))

    def of(t: Column) -> Column:
        words = F.array_join(F.flatten(F.transform(_all(t, PARAGRAPH), lambda p: F.transform(_all(p, WORDS), lambda x: F.left(F.sha2(x, 256), F.lit(8))))), "")
        short = lambda piece: let(_tree(t, piece), lambda x: F.concat(head(x), joined(x, "leaves"), F.lit("|")))
        middle = F.when(F.length(t) <= 2 * SHORT, words).otherwise("")
        return F.when(F.length(t) <= TINY, short(FOURS)).when(F.length(t) <= SHORT, short(WORDS)).otherwise(let(_tree(t, SENTENCE), lambda x: F.concat(head(x), middle, F.lit("|"), joined(x, "leaves"))))

    return let(F.coalesce(text.cast("string"), F.lit("")), of)


def root(fp: Column) -> Column:
    return F.left(fp, F.lit(64))


def _shape(fp: Column) -> Column:
    return F.substring_index(fp, "|", 1)


def likeness(a: Column, b: Column) -> Column:
    """Twice the common pieces of two fingerprints by the sum of their pieces, equal ones counted once; of paragraphs where they have no kind in common. 1 where the roots are equal."""

    def of(x: Column, y: Column) -> Column:
        common = F.size(F.array_intersect(x, y)) * F.lit(2.0)
        both = F.size(x) + F.size(y)
        return F.when(both > 0, common / both).otherwise(0.0)

    leaves = lambda fp, kind: F.array_distinct(_all(F.get(F.split(fp, r"\|"), F.lit(kind)), "[0-9a-f]{8}"))
    paragraphs = lambda fp: F.array_distinct(_all(_shape(fp), r"\.[0-9a-f]{12}"))
    part = lambda cut: let(cut(a), lambda x: let(cut(b), lambda y: of(x, y)))
    has = lambda kind: (F.get(F.split(a, r"\|"), F.lit(kind)) != "") & (F.get(F.split(b, r"\|"), F.lit(kind)) != "")
    by_kind = F.when(has(1), part(lambda fp: leaves(fp, 1))).when(has(2), part(lambda fp: leaves(fp, 2)))
    return F.when(root(a) == root(b), 1.0).otherwise(F.coalesce(by_kind, part(paragraphs)))


def edits(a: Column, b: Column) -> Column:
    """Where fingerprint `a` has branches that `b` doesn't have: (section, paragraph), both from 0, in order. Equal sections aren't entered."""
    others = lambda pattern: F.array_distinct(_all(_shape(b), pattern))
    sections = F.transform(_all(_shape(a), "/[^/|]*"), lambda s, i: F.struct(F.left(s, F.lit(17)).alias("h"), F.transform(_all(s, r"\.[0-9a-f]{12}"), lambda p, j: F.struct(i.alias("section"), j.alias("paragraph"), p.alias("h"))).alias("of")))

    def differing(known_sections: Column, known: Column) -> Column:
        changed = F.filter(sections, lambda s: ~F.array_contains(known_sections, s["h"]))
        inside = F.filter(F.flatten(F.transform(changed, lambda s: s["of"])), lambda p: ~F.array_contains(known, p["h"]))
        return F.transform(inside, lambda p: F.struct(p["section"].alias("section"), p["paragraph"].alias("paragraph")))

    return F.when(root(a) == root(b), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(let(others("/[0-9a-f]{16}"), lambda x: let(others(r"\.[0-9a-f]{12}"), lambda y: differing(x, y))))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) of each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.length(text).cast("long").alias("n_chars"), fingerprint(text).alias("fingerprint"))


def _range_of(value: Column, bounds: list[int]) -> tuple[Column, Column]:
    """How many of the bounds, which descend, come before the last one that isn't below a value; and whether that one is the value. By blocks of bounds first."""
    width = max(1, round(len(bounds) ** 0.5))
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    longs = lambda xs: F.array(*map(F.lit, xs)).cast("array<bigint>")
    reached = lambda xs: F.size(F.filter(xs, lambda x: x >= value))
    table, full = F.array(*map(longs, blocks)), reached(longs([b[-1] for b in blocks]))
    at = let(full, lambda k: F.least(k * F.lit(width) + F.coalesce(reached(F.get(table, k)), F.lit(0)), F.lit(len(bounds))) - 1)  # the last block may be short
    return at, let(at, lambda i: F.get(F.get(table, F.floor(i / width).cast("int")), i % width) == value)


def with_next(rows: DataFrame, id_col: str, carried: list[str]) -> DataFrame:
    """`rows` with a struct `next`: the carried columns of the next row by descending id; after the last comes the first. The rows are shuffled once.

    Ids are dealt to ranges that begin with ids of the table: the largest, and a sample by hash, about one in RANGE and RANGES at most.
    The row that begins a range goes to the range before it too, where it is the last row's next. Rows of one id
    follow each other, ordered by what is carried. A null id has no next.
    """
    ids = rows.select(F.col(id_col).alias("id")).filter("id IS NOT NULL")
    n, most = ids.agg(F.count("*"), F.max("id")).first()
    kind = rows.select(F.struct(*carried).alias("x")).schema["x"].dataType
    lone = rows.filter(F.col(id_col).isNull()).withColumn("next", F.lit(None).cast(kind))
    if not n:
        return lone
    sample = ids.filter(F.pmod(F.xxhash64("id"), F.lit(max(RANGE, -(-n // RANGES)))) == 0).distinct()
    bounds = sorted({most, *(r.id for r in sample.toLocalIterator())}, reverse=True)
    at, begins = _range_of(F.col(id_col), bounds)
    places = let(at, lambda k: F.when(begins, F.array(F.struct(k.alias("at"), F.lit(0).alias("guest")), F.struct(F.pmod(k - 1, F.lit(len(bounds))).alias("at"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct(k.alias("at"), F.lit(0).alias("guest")))))
    held = rows.filter(F.col(id_col).isNotNull()).select("*", F.explode(places).alias("place"))
    order = Window.partitionBy("place.at").orderBy("place.guest", F.desc(id_col), *carried)
    return held.withColumn("next", F.lead(F.struct(*carried)).over(order)).filter("place.guest = 0").drop("place").unionByName(lone)


def fingerprint_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_edited.

    The edited text has the first half of the next document by descending doc_id in place of its own second half. n_edited counts the
    paragraphs of the text that the edited one doesn't have, found in the fingerprints alone. Null texts are empty. A row without an id has no
    next document: its second half is cut off, and near_next is its likeness to an empty text. A repeated id's rows follow each other.
    An empty table gives no rows. Other columns of `docs` are not looked at.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = with_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), fingerprint(text).alias("fingerprint")), "doc_id", ["text", "fingerprint"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.coalesce(F.left("next.text", half), F.lit("")))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", F.coalesce("next.fingerprint", fingerprint(F.lit(""))).alias("of_next"), edited.alias("edited"))
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    fp, of_edited = F.col("fingerprint"), F.col("edited_fingerprint")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(fp, of_edited).alias("near_edited"), likeness(fp, F.col("of_next")).alias("near_next"), F.size(edits(fp, of_edited)).cast("long").alias("n_edited"),
    )
