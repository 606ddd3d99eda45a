"""Candidate rules: each row gets the first reason that applies; aggregates of reasons and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import urls
from ..functions.text import normal_patterns
from ..tables import unused

# Reasons in the order in which they apply.
MISSING, BAD_URL, EXTERNAL, SELF, REPEAT = "必須項目不足", "不正なURL", "外部ドメインまたは非HTTP URL", "情報源ページ自身へのリンク", "重複URL"
CATEGORY, EXCLUDED, NOT_INCLUDED = "category_includesで除外", "title_excludesで除外", "title_includesで除外"
NOT_ADVANCED = [
    "Claude CLI usage limit reached.", "Preview mode.", "Manual --since override was used.", "One or more candidates failed.",
    "Unprocessed candidates remain because of --limit.",
]
NOTICES = ["pdf_limit", "pdf_truncated", "ai_json_parse_retry", "pdf_empty_text", "pdf_duplicate"]


def title_matches(title: Column, patterns: Column) -> Column:
    """Whether any pattern is part of the title; both are normalised already. No patterns match nothing."""
    return F.exists(F.coalesce(patterns, F.array().cast("array<string>")), lambda p: (p != "") & F.contains(title, p))


def normalised(rows: DataFrame, patterns: list[str]) -> DataFrame:
    """`rows` with the named arrays of patterns or categories normalised as titles are, without empty ones."""
    return rows.withColumns({c: normal_patterns(F.col(c)) for c in patterns if c in rows.columns})


def title_verdict(title: Column, includes: Column, excludes: Column) -> Column:
    """A reason or null; excludes go first, and without includes every title is included."""
    none = F.coalesce(F.size(includes), F.lit(0)) <= 0
    return F.when(title_matches(title, excludes), EXCLUDED).when(~none & ~title_matches(title, includes), NOT_INCLUDED)


def judged(candidates: DataFrame, list_page: bool | Column = True) -> DataFrame:
    """`exclude_reason` of rows (source_id, pos, title, url, norm_title, domain, source_url, includes, excludes, categories, category_includes).

    Patterns and categories are normalised here as `norm_title` is. Repeats are found among rows that pass what comes before; others
    meet in no window. Links to the source's own page are a rule of list pages, categories one of the others; `list_page` tells which a row is.
    """
    lists = F.lit(list_page) if isinstance(list_page, bool) else list_page
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    early, own, page, domain, k = (unused(candidates, x) for x in ("early", "own_url", "is_list", "own_domain", "k"))
    rows = normalised(candidates, ["includes", "excludes", "categories", "category_includes"])
    rows = rows.withColumns({"canonical_url": urls.canonical(F.col("url")), own: urls.canonical(F.col("source_url")), domain: urls.normal_domain(F.col("domain")), page: lists})
    scheme = urls.scheme(F.trim("url"))
    wrong = (
        F.when(blank(F.col("title")) | blank(F.col("url")), MISSING).when((scheme == "") | (scheme.isin("http", "https") & F.col("canonical_url").isNull()), BAD_URL)
        .when(~scheme.isin("http", "https") | ~urls.allowed(urls.host(F.col("canonical_url")), F.array(domain)), EXTERNAL)
        .when(F.col(page) & (F.col("canonical_url") == F.col(own)), SELF)
    )
    rows = rows.withColumn(early, wrong)
    # rows with a reason already are dealt by their place, as many may share a blank URL
    key = F.when(F.col(early).isNull(), F.col("canonical_url")).otherwise(F.concat(F.lit("#"), F.col("pos").cast("string")))
    rows = rows.withColumn(k, F.row_number().over(Window.partitionBy("source_id", key).orderBy("pos")))
    late = F.when(F.col(k) > 1, REPEAT)
    if "category_includes" in candidates.columns:
        wanted = F.coalesce(F.size("category_includes"), F.lit(0)) > 0
        late = late.when(~F.col(page) & wanted & ~F.coalesce(F.exists("categories", lambda c: title_matches(c, F.col("category_includes"))), F.lit(False)), CATEGORY)
    reason = F.coalesce(F.col(early), late, title_verdict(F.col("norm_title"), F.col("includes"), F.col("excludes")))
    return rows.withColumn("exclude_reason", reason).drop(early, own, page, domain, k)


def exclusion_counts(rows: DataFrame) -> DataFrame:
    """source_id, reason, n, first_pos."""
    return rows.filter("exclude_reason IS NOT NULL").groupBy("source_id", F.col("exclude_reason").alias("reason")).agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def period_state(published: Column, since: Column, run: Column) -> Column:
    """unknown (no date, or a future one: kept), in, or out."""
    return F.when(published.isNull() | (published > run), "unknown").when(published >= since, "in").otherwise("out")


def severity(code: Column, detail: Column, message: Column) -> Column:
    notice = code.isin(NOTICES) | ((code == "pdf_warning") & F.coalesce(detail == "japanese_character_spacing", F.lit(False))) | ((code == "content_warning") & F.contains(message, F.lit("公開日候補を取得できませんでした")))
    return F.when(notice, "notice").otherwise("warning")


def commit_reason(limit_hit: Column, write: Column, manual: Column, failed: Column, remaining: Column) -> Column:
    """Why the state isn't advanced, or null where it is."""
    return (
        F.when(limit_hit, NOT_ADVANCED[0]).when(~write, NOT_ADVANCED[1]).when(manual, NOT_ADVANCED[2]).when(failed > 0, NOT_ADVANCED[3]).when(remaining > 0, NOT_ADVANCED[4])
    )


def new_candidates(probe: DataFrame, sink: DataFrame, url: str, sink_url: str) -> DataFrame:
    """Rows of `probe` that the sink has neither by their URL nor by its https form. One equality join on exploded keys."""
    hit = probe.select(F.col(url).alias("probe"), F.explode(F.array_compact(F.array(F.col(url), urls.https_of(F.col(url))))).alias("key")).distinct()
    known = hit.join(sink.select(F.col(sink_url).alias("key")).distinct(), "key", "left_semi").select("probe").distinct()
    name = unused(probe, "probe")
    return probe.join(known.withColumnRenamed("probe", name), F.col(url) == F.col(name), "left_anti")
