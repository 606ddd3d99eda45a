"""Source check: scans of all sources by collector type in one plan; a source that fails is a row, and stops no other."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import date_candidate
from ..functions.text import for_match
from ..functions.urls import resolved
from ..operators import rules
from ..operators.select import first_rows
from ..sources import feeds, files, html

CANDIDATE = ["source_id", "pos", "title", "url", "published_at", "categories"]
FETCHABLE = ["rss", "list_page", "single_page"]
NO_SELECTOR = "link_selector is missing"


def scan(sources: DataFrame, fetched: DataFrame) -> DataFrame:
    """Candidates of sources (id, name, url, collector_type, link_selector) and fetched (source_id, base_url, body): list pages, feeds, fixed pages.

    A source that can't be read is one row with null in place of a candidate and `scan_error`; fixed pages need no body.
    """
    got = sources.join(fetched.select("source_id", "base_url", "body"), sources.id == fetched.source_id, "left").withColumn("source_id", F.col("id"))
    none, no_error = F.array().cast("array<string>"), F.lit(None).cast("string")
    fixed = sources.filter("collector_type = 'single_page'").select(F.col("id").alias("source_id"), F.lit(0).alias("pos"), F.col("name").alias("title"), "url", F.lit(None).cast("date").alias("published_at"), none.alias("categories"), no_error.alias("scan_error"))
    xml = feeds.items(got.filter("collector_type = 'rss'").select("source_id", F.col("body").alias("xml")), errors=True).select(*CANDIDATE, "scan_error")
    pages = got.filter("collector_type = 'list_page'").select("source_id", "base_url", "body", "link_selector")

    @F.pandas_udf("links array<struct<href:string,text:string,context:string>>, error string")
    def found(body, selector):
        import pandas as pd

        rows = [([], "empty") if not b else ([], NO_SELECTOR) if s is None else html.links_of(b, s) for b, s in zip(body, selector)]
        return pd.DataFrame(rows, columns=["links", "error"])

    links = pages.select("source_id", "base_url", found("body", "link_selector").alias("f")).select("source_id", "base_url", "f.error", F.posexplode_outer("f.links").alias("pos", "a"))
    links = links.select("source_id", "pos", F.col("a.text").alias("title"), F.when(F.trim("a.href") != "", F.coalesce(resolved("base_url", F.col("a.href")), F.trim("a.href"))).alias("url"), date_candidate(F.col("a.context")).alias("published_at"), none.alias("categories"), F.col("error").alias("scan_error"))
    return fixed.unionByName(xml).unionByName(links)


def judged_candidates(sources: DataFrame, orgs: DataFrame, fetched: DataFrame) -> DataFrame:
    """What `scan` gives, with each source's settings and `exclude_reason`; candidates without one are usable. Sources of unknown organizations allow no domain."""
    of = orgs.select(F.col("id").alias("organization_id"), F.col("official_domain").alias("domain"))
    src = sources.join(of, "organization_id", "left").select(
        F.col("id").alias("source_id"), "collector_type", "domain", F.col("url").alias("source_url"), "category_includes", F.col("title_includes").alias("includes"), F.col("title_excludes").alias("excludes"),
    )
    rows = scan(sources, fetched).join(src, "source_id").withColumn("norm_title", for_match(F.col("title")))
    # a fixed page is its source's own page, so the rule against self links is for list pages
    return rules.judged(rows, F.col("collector_type") == "list_page")


def check(sources: DataFrame, orgs: DataFrame, fetched: DataFrame, limit: int = 3) -> DataFrame:
    """A row per source: status, counts at each step, latest date, what is missing, warnings, the first `limit` usable samples, and the error of its scan.

    `status` is unsupported for other collector types; error where a source can't be read, has an unknown organization or gives no usable row (an empty
    list page may be allowed to); warning with any of `warnings`: missing titles or URLs, external, self and repeated links, more than half
    of a feed's dates missing, an empty list, and headers (`content_type` of fetched, where it is given) that don't fit; else ok.
    """
    judged = judged_candidates(sources, orgs, fetched)
    rows, why = F.col("pos").isNotNull(), F.col("exclude_reason")
    sound = rows & (why.isNull() | ~why.isin(rules.MISSING, rules.BAD_URL, rules.EXTERNAL, rules.SELF))
    usable, lacks = rows & why.isNull(), lambda c: rows & F.coalesce(F.trim(c) == "", F.lit(True))
    counts = judged.groupBy("source_id").agg(
        F.count_if(rows).alias("raw"), F.count_if(sound).alias("valid"), F.count_if(usable).alias("usable"), F.max(F.when(usable, F.col("published_at"))).alias("latest"),
        F.count_if(lacks("title")).alias("missing_title"), F.count_if(lacks("url")).alias("missing_url"), F.count_if(rows & F.col("published_at").isNull()).alias("missing_date"),
        F.count_if(rows & (why == rules.EXTERNAL)).alias("external"), F.count_if(rows & (why == rules.SELF)).alias("self_links"), F.count_if(rows & (why == rules.REPEAT)).alias("repeats"), F.max("scan_error").alias("scan_error"),
    )
    samples = first_rows(judged.filter(usable), ["source_id"], ["pos"], limit).groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("pos", "title", "url", "published_at"))).alias("samples"))
    known = orgs.select(F.col("id").alias("organization_id"), F.lit(True).alias("known"))
    src = sources.join(known, "organization_id", "left").select(F.col("id").alias("source_id"), "collector_type", "enabled", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("allow_empty_candidates", F.lit(False)).alias("empty_ok"))
    header = F.lit(None).cast("string")
    if "content_type" in fetched.columns:
        src = src.join(fetched.select("source_id", "content_type", F.lit(True).alias("was_fetched")), "source_id", "left")
        header = F.when(F.col("was_fetched"), files.content_type_warning(F.col("collector_type"), F.col("content_type")))
    numbers = [c for c in counts.columns if c not in ("source_id", "latest", "scan_error")]
    all_ = src.join(counts, "source_id", "left").fillna(0, numbers).join(samples, "source_id", "left")
    feed, is_list = F.col("collector_type") == "rss", F.col("collector_type") == "list_page"
    empty = F.col("empty_ok") & is_list & (F.col("scan_error") == html.NO_MATCH)
    found = {
        "missing": (F.col("missing_title") > 0) | (F.col("missing_url") > 0), "dates": feed & (F.col("missing_date") > F.col("raw") / 2), "external": F.col("external") > 0,
        "self_links": F.col("self_links") > 0, "repeats": F.col("repeats") > 0, "empty": F.coalesce(empty, F.lit(False)),
    }
    warnings = F.when(feed | is_list, F.array_compact(F.array(*[F.when(c, k) for k, c in found.items()], header))).otherwise(F.array_compact(F.array(header)))
    bad = ~F.col("known") | ((F.col("scan_error").isNotNull() | (F.col("usable") == 0)) & ~F.coalesce(empty, F.lit(False)))
    all_ = all_.withColumn("warnings", warnings)
    status = F.when(~F.col("collector_type").isin(FETCHABLE), "unsupported").when(bad, "error").when(F.size("warnings") > 0, "warning").otherwise("ok")
    error = F.when(status == "error", F.when(~F.col("known"), "unknown organization").otherwise(F.coalesce("scan_error", F.lit("no usable candidate"))))
    return all_.select(
        "source_id", "enabled", status.alias("status"), "raw", "valid", "usable", "latest", "missing_title", "missing_url", "missing_date", "external", "self_links", "repeats", "warnings",
        error.alias("error"), "samples",
    )
