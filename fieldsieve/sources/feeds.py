"""RSS 2.0 and RSS 1.0 (RDF) feeds as candidate rows: each feed is read once, by the standard library's parser, in an Arrow function."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.dates import date_candidate
from ..functions.text import squeeze
from ..tables import unused

# What an item is read for; names with a prefix count in RDF feeds only, where the plain one is absent.
_ONE, _MANY = ["title", "link", "pubDate", "dc:date"], ["category", "dc:subject"]
_ITEM = T.StructType([T.StructField(n.replace(":", "_"), T.StringType()) for n in _ONE] + [T.StructField(n.replace(":", "_"), T.ArrayType(T.StringType())) for n in _MANY])
_FEED = T.StructType([T.StructField("items", T.ArrayType(_ITEM)), T.StructField("error", T.StringType())])


def read_feed(xml: str | None) -> tuple[list[dict], str | None]:
    """The items of a feed, or an error: a document type, XML that isn't well formed, neither a channel nor RDF, or no items."""
    if xml is None or not xml.strip():
        return [], "empty"
    if re.search("<!DOCTYPE", xml, re.I):
        return [], "document type"
    path: list[str] = []
    items: list[dict] = []
    kinds: set[str] = set()
    item: dict | None = None
    text: list[str] = []

    def begin(name: str, _) -> None:
        nonlocal item, text
        path.append(name)
        if path == ["rss", "channel"] or name in ("rdf:RDF", "RDF") and len(path) == 1:
            kinds.add("rss" if name == "channel" else "rdf")
        elif path == ["rss", "channel", "item"] or len(path) == 2 and path[0] in ("rdf:RDF", "RDF") and name == "item":
            item = {}
        if item is not None:
            text = []

    def end(name: str) -> None:
        nonlocal item, text
        at_item = 3 if path[0] == "rss" else 2
        if item is not None and len(path) == at_item + 1:
            value = "".join(text).strip()
            if name in _MANY:
                item.setdefault(name.replace(":", "_"), []).append(value)
            elif name in _ONE:
                item.setdefault(name.replace(":", "_"), value)
        if item is not None and len(path) == at_item:
            items.append({f.name: item.get(f.name) for f in _ITEM.fields})
            item = None
        path.pop()
        text = []

    parser = expat.ParserCreate("utf-8")
    parser.StartElementHandler, parser.EndElementHandler = begin, end
    parser.CharacterDataHandler = lambda s: text.append(s) if item is not None else None
    try:
        parser.Parse(re.sub(r"^\s*<\?xml[^>]*\?>", "", xml.lstrip("\ufeff")).encode("utf-8", "replace"), True)
    except expat.ExpatError as e:
        return [], f"not well formed: {e}"
    if not kinds:
        return [], "no channel"
    if "rss" in kinds:
        items = [x | {"dc_date": None, "dc_subject": None} for x in items]
    return items, None if items else "no items"


@F.pandas_udf(_FEED)
def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        yield pd.DataFrame([read_feed(x) for x in s], columns=["items", "error"])


def subjects(c: Column) -> Column:
    """Subjects split at commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, "[,、]"), squeeze), lambda x: x != "")


def items(feeds: DataFrame, xml: str = "xml", errors: bool = False) -> DataFrame:
    """A row for each item: the feed's other columns, pos, title, url, published_at, categories.

    A feed that can't be read gives no rows, or, with `errors`, one row with null in place of an item and `scan_error`.
    Comments aren't read. Entities are decoded. Columns of the feed that have a name of these are replaced.
    """
    keep = [c for c in feeds.columns if c.lower() not in (xml.lower(), "pos", "title", "url", "published_at", "categories", "scan_error")]
    f, i, error = (unused(feeds, x) for x in ("feed_", "item_", "error_"))
    rows = feeds.select(*keep, parsed(xml).alias(f))
    explode = F.posexplode_outer if errors else F.posexplode
    rows = rows.select(*keep, F.col(f"{f}.error").alias(error), explode(f"{f}.items").alias("pos", i))
    cats = F.coalesce(F.when(F.size(f"{i}.category") > 0, F.col(f"{i}.category")), F.when(F.size(f"{i}.dc_subject") > 0, F.flatten(F.transform(f"{i}.dc_subject", subjects))), F.array().cast("array<string>"))
    out = rows.select(*keep, "pos", squeeze(F.col(f"{i}.title")).alias("title"), F.trim(f"{i}.link").alias("url"), date_candidate(F.coalesce(f"{i}.pubDate", f"{i}.dc_date")).alias("published_at"), cats.alias("categories"), F.col(error).alias("scan_error"))
    return out if errors else out.drop("scan_error")
