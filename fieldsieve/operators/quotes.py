"""Where quotes stand in texts: begin and end in the text as it is, though both are compared in a normal form.

Quotes of one text come to it together, so a text is read and normalised once, however many quotes it has. The normal form keeps, for each of
its characters, which part of the text it comes from.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..tables import unused

#: Quotes that come to a text at once, about, at most.
TOGETHER = 10_000

# White space as `for_evidence` has it, and quotes that are taken for straight ones.
_SPACES = re.compile("[\t-\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")
_STRAIGHT = str.maketrans("“”„‟〝〞〟‘’‚‛", '"' * 7 + "'" * 4)


@functools.cache
def _seconds() -> frozenset[str]:
    """Characters that can join with the one before though they are no marks: second parts of canonical pairs, and Hangul vowels and finals."""
    pairs = (unicodedata.decomposition(c).split() for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.decomposition(c)[:1] not in ("", "<"))
    found = {chr(int(p[1], 16)) for p in pairs if len(p) == 2}
    return frozenset(found | set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)])))


@functools.lru_cache(1 << 16)
def _begins(c: str) -> bool:
    """Whether nothing before a character changes what it becomes."""
    first = unicodedata.normalize("NFKD", c)[0]
    return unicodedata.combining(first) == 0 and first not in _seconds()


def normal_places(text: str) -> tuple[str, list[int], list[int]]:
    """The text as `for_evidence` makes it, and for each of its characters where in the text it begins and ends."""
    chars: list[str] = []
    begin: list[int] = []
    end: list[int] = []
    if text.isascii():
        chars, begin, end = list(text), list(range(len(text))), list(range(1, len(text) + 1))
    else:
        at = 0
        while at < len(text):
            to = at + 1
            while to < len(text) and not (text[to].isascii() or _begins(text[to])):
                to += 1
            part = text[at:to]
            new = part if part.isascii() else unicodedata.normalize("NFKC", part).translate(_STRAIGHT)
            chars += new
            begin += [at] * len(new)
            end += [to] * len(new)
            at = to
    plain = "".join(chars)
    out: list[str] = []
    places: list[int] = []
    word = lambda c: c.isascii() and c.isalnum()
    at = 0
    for m in [*_SPACES.finditer(plain), None]:
        to = m.start() if m else len(plain)
        out += plain[at:to]
        places += range(at, to)
        if m and out and m.end() < len(plain) and word(out[-1]) and word(plain[m.end()]):
            out.append(" ")
            places.append(m.start())
        at = m.end() if m else to
    return "".join(out), [begin[k] for k in places], [end[k] for k in places]


def places_of(text: str, quotes: list[str]) -> list[tuple[int, int] | None]:
    """The first place (begin, end) of each quote in a text; null where it isn't, or is empty in its normal form. The end of a quote is that of its last character."""
    plain, begin, end = normal_places(text)
    out: list[tuple[int, int] | None] = []
    for q in quotes:
        w = normal_places(q)[0]
        k = plain.find(w) if w else -1
        out.append(None if k < 0 else (begin[k], end[k + len(w) - 1]))
    return out


def quote_places(quotes: DataFrame, texts: DataFrame, keys: list[str], quote: str = "quote", text: str = "text") -> DataFrame:
    """`quotes` with begin and end (code points, from 0) of the first place in the text of the same keys, null where it isn't there.

    The texts' keys are unique. Quotes of a key are gathered, TOGETHER at once, and equal ones looked up once; what comes to a task with a text is its
    quotes, not the text once for each. Null quotes, texts and keys find nothing. Columns named begin or end are replaced.
    """
    rows = quotes.drop("begin", "end")
    each = rows.select(*keys, F.col(quote).alias(q := unused(rows, "own_quote"))).filter(F.col(q).isNotNull()).distinct()
    slices = max(1, -(-each.count() // (TOGETHER * 1000)))
    lists = each.groupBy(*keys, F.pmod(F.xxhash64(q), F.lit(slices)).alias("own_slice")).agg(F.collect_list(q).alias("own_quotes"))
    met = lists.join(texts.select(*keys, F.col(text).alias("own_text")).filter("own_text IS NOT NULL"), keys)
    schema = T.StructType([*[met.schema[k] for k in keys], T.StructField("own_quote", T.StringType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                asked, held = part.column("own_quotes").to_pylist(), part.column("own_text").to_pylist()
                found = [(i, w, p) for i, (ws, t) in enumerate(zip(asked, held)) for w, p in zip(ws, places_of(t, ws)) if p]
                take = pa.array([i for i, _, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k).take(take) for k in keys], pa.array([w for _, w, _ in found], pa.string()), pa.array([p[0] for _, _, p in found], pa.int32()), pa.array([p[1] for _, _, p in found], pa.int32())],
                    names=[*keys, "own_quote", "begin", "end"],
                )

    return rows.withColumn("own_quote", F.col(quote)).join(met.mapInArrow(run, schema), [*keys, "own_quote"], "left").drop("own_quote").select(*rows.columns, "begin", "end")
