"""Checks of single pages and attachments: the rows that the commands show, for any number of pages at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import urls
from ..operators.hierarchy import ancestor_domains, closure
from ..sources import files, html
from ..tables import unused

HTML = ["text/html", "application/xhtml+xml"]


def trusted_domains(orgs: DataFrame) -> DataFrame:
    """organization_id, domains: an organization's own domain and those of its ancestors, each once, in normal form."""
    of = ancestor_domains(closure(orgs, "id", "parent_organization_id"), orgs.select("id", F.col("official_domain").alias("domain"))).select(F.col("node").alias("organization_id"), "domains")
    own = orgs.select(F.col("id").alias("organization_id"), F.array("official_domain").alias("own"))
    joined = own.join(of, "organization_id").select("organization_id", F.explode(F.array_union("own", "domains")).alias("d"))
    return joined.groupBy("organization_id").agg(F.collect_set(urls.normal_domain("d")).alias("domains"))


def with_source(rows: DataFrame, sources: DataFrame, orgs: DataFrame) -> DataFrame:
    """`rows` (source_id, url) with `notes`, that the source or its organization is disabled, and `refused`, why the URL isn't read: an unknown source or organization, or an unsafe address."""
    of = orgs.select(F.col("id").alias("organization_id"), F.col("enabled").alias("org_enabled")).join(trusted_domains(orgs), "organization_id")
    src = sources.select(F.col("id").alias("source_id"), "organization_id", F.col("enabled").alias("source_enabled"), "content_selector", "title_selector").join(of, "organization_id", "left")
    normal = unused(rows, "normal")
    out = rows.withColumn(normal, urls.canonical(F.col("url"))).join(src, "source_id", "left")
    notes = F.array_compact(F.array(F.when(~F.col("source_enabled"), "disabled source"), F.when(~F.col("org_enabled"), "disabled organization")))
    reason = F.when(F.col("organization_id").isNull(), "unknown source").when(F.col("domains").isNull(), "unknown organization").otherwise(urls.unsafe(F.col(normal), F.col("domains")))
    return out.withColumns({"notes": notes, "refused": reason}).drop("organization_id", "source_enabled", "org_enabled", normal)


def checked_documents(pages: DataFrame, sources: DataFrame, orgs: DataFrame) -> DataFrame:
    """source_id, url, title, body_text, body_length, published_at, published_at_source, pdf_links, warnings, error of pages (source_id, url, html, content_type).

    Selectors are the source's; all rows of one source share them, so pages are read once for each pair of selectors. A page that is refused or
    isn't HTML has an error and no text.
    """
    rows = with_source(pages, sources, orgs)
    media = F.when(~F.coalesce(files.media_type(F.col("content_type")).isin(HTML), F.lit(False)), "content type")
    rows = rows.withColumn("problem", F.coalesce("refused", media)).withColumn("html", F.when(F.col("problem").isNull(), F.col("html")))
    kinds = [tuple(r) for r in rows.select("content_selector", "title_selector").distinct().collect()]  # as many as the registry has
    out = None
    for body, title in kinds:
        some = rows.filter(F.col("content_selector").eqNullSafe(body) & F.col("title_selector").eqNullSafe(title)).select("source_id", "url", "html", "notes", "problem")
        read = html.documents(some, url="url", selectors=[body] if body else None, title_selector=title)
        out = read if out is None else out.unionByName(read)
    if out is None:
        out = html.documents(rows.select("source_id", "url", "html", "notes", "problem"), url="url")
    fell = F.when(F.col("problem").isNull() & F.col("error").isNull() & F.col("used_fallback") & (F.col("content_selector_used") == "body"), "whole body")
    date = F.when(F.col("problem").isNull() & F.col("published_at").isNull(), "no date")
    return out.select(
        "source_id", "url", "title", "body_text", F.length("body_text").alias("body_length"), "content_selector_used", "used_fallback", "published_at", "published_at_source", "pdf_links",
        F.concat("notes", F.array_compact(F.array(fell, date))).alias("warnings"), F.coalesce("problem", "error").alias("error"),
    )


def checked_pdfs(pdfs: DataFrame, sources: DataFrame, orgs: DataFrame, parser) -> DataFrame:
    """What `sources.pdf.extracted` says of pdfs (source_id, url, http_status, content_type, content), with `notes`; a file that is refused, failed or of another media type has an error_code."""
    from ..sources import pdf

    rows = files.fetch_errors(with_source(pdfs, sources, orgs), pdf.MOST_BYTES, ["application/pdf"])
    rows = rows.withColumn("problem", F.coalesce("refused", "error")).withColumn("content", F.when(F.col("problem").isNull(), F.col("content")))
    read = pdf.extracted(rows.select("source_id", "url", "notes", "problem", "content"), parser)
    return read.withColumn("error_code", F.coalesce("problem", "error_code")).drop("problem")


def skipped(links: DataFrame, used: DataFrame) -> DataFrame:
    """Links (doc_id, pos, url) that `used` (doc_id, bare) doesn't have, fragments apart, in their order within each document."""
    bare = links.withColumn("bare", F.regexp_replace("url", "#.*$", ""))
    return bare.join(used.select("doc_id", "bare"), ["doc_id", "bare"], "left_anti").drop("bare")
