"""Commands over a registry file and tables of fetched pages. Exit codes: 0 fine, 1 findings, 2 bad use.

Nothing is fetched here: `--fetched` (source_id, base_url, body, content_type) holds the sources' entry pages, `--pages` (source_id, url, html, content_type)
candidates' pages, `--pdfs` (source_id, url, http_status, content_type, content) attachments, all Parquet. `--sink` is a Parquet table of the sink's columns.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import analysis, hierarchy, report, sink
from .operators.once import new_store
from .plans import analyze, catalog, check, collection, pages as page_checks, register, site
from .sources import config, files, registry
from .tables import cut

COMMANDS = [
    "sources:validate", "sources:list", "sources:check", "content:check", "pdf:check", "ai:check", "source:verify", "sink:check", "sink:register", "sink:batch", "collect:run", "collect:batch", "site:build",
]
USE, FOUND = 2, 1


class BadUse(ValueError):
    """The command line asks for something that isn't there."""


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fieldsieve")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--registry", required=True)
    for name in ("organization", "source", "sources", "municipality", "url", "file", "fetched", "pages", "pdfs", "sink", "state", "since", "run-at", "output"):
        p.add_argument(f"--{name}")
    p.add_argument("--priority", choices=registry.PRIORITIES)
    p.add_argument("--limit", type=int)
    for name in ("enabled", "all", "write", "full", "json", "no-pdf"):
        p.add_argument(f"--{name}", action="store_true")
    return p


def _need(a, *names: str) -> None:
    if lacking := [n for n in names if not getattr(a, n)]:
        raise BadUse(f"{a.command} needs " + ", ".join(f"--{n}" for n in lacking))


def _limit(a, default: int, most: int) -> int:
    n = default if a.limit is None else a.limit
    if not 1 <= n <= most:
        raise BadUse(f"--limit is from 1 to {most}")
    return n


def _one(sources: DataFrame, id_: str) -> DataFrame:
    some = sources.filter(F.col("id") == id_)
    if not some.limit(1).count():
        raise BadUse(f"no source {id_!r}")
    return some


def _show(df: DataFrame, a, kind: str) -> list[dict]:
    """Prints the rows and writes them where --output says."""
    # a report for one reader, whole; partition by partition, so that it need not fit into one result of the driver's
    rows = [json.loads(r.row) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row")).toLocalIterator()]
    print(json.dumps(rows, ensure_ascii=False, indent=1) if a.json else report.text_table(df))
    if a.output is not None:
        files.write_json_atomic(a.output or files.default_output(kind, a.source or "all"), json.dumps(rows, ensure_ascii=False))
    return rows


def _read(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    for c in columns:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df


def _documents(spark, a, orgs, sources) -> DataFrame:
    _need(a, "source", "pages")
    _one(sources, a.source)
    rows = _read(spark, a.pages, "content_type").filter(F.col("source_id") == a.source)
    return page_checks.checked_documents(rows.filter(F.col("url") == a.url) if a.url else rows, sources, orgs)


def _analysed(spark, a, orgs, sources, parser) -> DataFrame:
    """url, final_url and what the mock analyzer says of the pages of a source."""
    docs = _documents(spark, a, orgs, sources).filter("error IS NULL").withColumn("doc_id", F.xxhash64("url"))
    links = docs.select("doc_id", F.posexplode("pdf_links").alias("pos", "x")).select("doc_id", "pos", "x.url", "x.text")
    texts = spark.createDataFrame([], "url string, body string, error string, page_texts array<string>")
    if a.pdfs and not a.no_pdf:
        read = page_checks.checked_pdfs(spark.read.parquet(a.pdfs), sources, orgs, parser)
        texts = read.select("url", F.col("text").alias("body"), F.col("error_code").alias("error"), "page_texts")
    limits = config.Limits.of()
    inputs = analyze.prepared(docs.select("doc_id", "url", F.col("body_text").alias("text"), "title"), analyze.attachments(links, texts, limits), limits)
    return analyze.analyzed(inputs)


def _sink_urls(spark, a) -> tuple[DataFrame, DataFrame]:
    """(official_url) and (option) of the sink."""
    if not a.sink:
        return spark.createDataFrame([], "official_url string"), spark.createDataFrame([(c,) for c in analysis.NEED_CATEGORIES], "option string")
    table = sink.stored(spark, a.sink)
    return table.select(F.col("公式URL").alias("official_url")), spark.createDataFrame([(c,) for c in analysis.NEED_CATEGORIES], "option string")


def _registered(spark, a, orgs, sources, parser, wanted: DataFrame) -> DataFrame:
    made = cut(_analysed(spark, a, orgs, sources, parser).select("url", "categories"), "analysed")
    said = made.select("url", F.col("url").alias("final_url"), "categories", F.lit(None).cast("string").alias("error_class"), F.lit("").alias("message"))
    known, options = _sink_urls(spark, a)
    return register.registered(wanted, said, known, options, a.write, "mock")


def _collect(spark, a, orgs, sources) -> int:
    _need(a, "fetched", "state")
    limit = _limit(a, 5, 20)
    manual = None
    if a.since is not None:
        try:
            manual = F.lit(dt.date.fromisoformat(a.since))
        except ValueError:
            raise BadUse("--since is a date, YYYY-MM-DD") from None
    if a.command == "collect:run":
        _need(a, "source")
        chosen = registry.selected(spark, orgs, sources, ids=[a.source])
    else:
        chosen = registry.selected(spark, orgs, sources, a.municipality, a.all, a.sources.split(",") if a.sources else None)
    at = F.lit(a.run_at).cast("timestamp") if a.run_at else F.current_timestamp()
    known, _ = _sink_urls(spark, a)
    named, candidates = collection.collected(chosen, orgs, spark.read.parquet(a.fetched), files.read_state(spark, a.state), known, at, manual)
    named, candidates = cut(named, "sources"), cut(candidates, "candidates")  # read once, whatever is asked of them
    # the mock analyzer's results are never written, so a run that writes fails for each new candidate
    said = lambda rows: rows.select("source_id", "url", F.lit(not a.write).alias("ok"), F.lit(False).alias("limit_hit"))
    outcomes = collection.run_in_waves(named, candidates, said, limit, new_store(spark, "run"), 8 * spark.sparkContext.defaultParallelism, a.write, manual is not None)
    out, code = collection.commit(spark, a.state, cut(outcomes, "outcomes"), at)
    _show(out.orderBy("place"), a, "collection")
    if a.command == "collect:batch":
        print(report.text_table(collection.batch_totals(named, out)))
    return code


def _run(a, spark: SparkSession, parser) -> int:
    with open(a.registry, encoding="utf-8") as f:
        orgs, sources = registry.load(spark, f.read())
    if a.command == "sources:validate":
        found = registry.violations(orgs, sources)
        print(report.text_table(found.select(report.issue_path(F.col("coll"), F.col("pos"), F.col("field")).alias("path"), "issue")))
        print(report.text_table(registry.totals(orgs, sources)))
        return int(found.limit(1).count() > 0)
    if a.command == "sources:list":
        print(report.text_table(registry.listed(orgs, sources, a.organization, a.priority, True if a.enabled else None).select("organization", "id", "name", "priority", "enabled")))
        return 0
    if a.command == "sources:check":
        if (a.source is not None) + a.enabled + a.all != 1 or not a.fetched:
            raise BadUse("one of --source, --enabled and --all, and --fetched")
        some = _one(sources, a.source) if a.source else registry.enabled_sources(orgs, sources) if a.enabled else sources
        if not some.limit(1).count():
            raise BadUse("no such source")
        results = check.check(some, orgs, spark.read.parquet(a.fetched), _limit(a, 3, 20)).cache()
        _show(results, a, "sources")
        return sink.exit_code(results, a.source is not None).first().exit_code
    if a.command == "content:check":
        docs = _documents(spark, a, orgs, sources).cache()
        _show(docs if a.full else report.report_rows(docs, "body_text"), a, "content")
        return int(docs.filter("error IS NOT NULL").limit(1).count() > 0 or not docs.limit(1).count())
    if a.command == "pdf:check":
        _need(a, "source", "pdfs")
        _one(sources, a.source)
        rows = spark.read.parquet(a.pdfs).filter(F.col("source_id") == a.source)
        read = page_checks.checked_pdfs(rows.filter(F.col("url") == a.url) if a.url else rows, sources, orgs, parser).cache()
        _show(read if a.full else report.report_rows(read, "text", "page_texts"), a, "pdf")
        return int(read.filter("error_code IS NOT NULL").limit(1).count() > 0 or not read.limit(1).count())
    if a.command == "ai:check":
        made = _analysed(spark, a, orgs, sources, parser).cache()
        _show(made.select("url", "is_target", "document_type", "categories", "company_relevance", "contact_recommendation", "matched", "quotes", "total_sent"), a, "ai")
        return int(not made.limit(1).count())
    if a.command == "source:verify":
        _need(a, "source", "fetched", "pages")
        some = _one(sources, a.source)
        usable = check.judged_candidates(some, orgs, spark.read.parquet(a.fetched)).filter("pos IS NOT NULL AND exclude_reason IS NULL").select("source_id", "pos", "url")
        docs = _documents(spark, a, orgs, sources).filter("error IS NULL").select("url")
        items = register.verified(usable, docs, _analysed(spark, a, orgs, sources, parser).select("url"), _limit(a, 3, 5)).cache()
        _show(items, a, "verify")
        summary = report.verification_summary(items, ["source_id"])
        print(report.text_table(summary))
        return int(not summary.filter("ready").limit(1).count())
    if a.command == "sink:check":
        _need(a, "sink")
        kinds = {"array<string>": ("rich_text", "multi_select"), "string": ("title", "url", "select"), "timestamp": ("created_time",)}
        actual = [(n, sink.COLUMNS[n] if sink.COLUMNS.get(n) in kinds.get(k, ()) else k) for n, k in sink.stored(spark, a.sink).dtypes]
        wrong = sink.mismatches(spark.createDataFrame(actual, "name string, kind string"))
        print(report.text_table(wrong))
        return int(wrong.limit(1).count() > 0)
    if a.command == "sink:register":
        _need(a, "source", "url", "pages")
        out = _registered(spark, a, orgs, sources, parser, spark.createDataFrame([(a.url,)], "url string")).cache()
        _show(out, a, "register")
        return int(out.filter("status = 'failed'").count() > 0)
    if a.command == "sink:batch":
        _need(a, "source", "file", "pages")
        entries = files.selected_urls(spark.read.text(a.file, wholetext=True))
        out = register.listed(entries, _registered(spark, a, orgs, sources, parser, entries.select("url").distinct()), F.lit(False)).cache()
        _show(out.orderBy("line"), a, "batch")
        print(report.text_table(register.list_summary(out.withColumn("list", F.lit(a.file)), ["list"])))
        return int(out.filter("status = 'failed'").count() > 0)
    if a.command in ("collect:run", "collect:batch"):
        return _collect(spark, a, orgs, sources)
    found = registry.violations(orgs, sources)
    if found.limit(1).count():
        print(report.text_table(found), file=sys.stderr)
        return FOUND
    closed = hierarchy.closure(orgs, "id", "parent_organization_id")
    dim, roots = catalog.prefectures(spark), hierarchy.roots(closed)
    wrong = hierarchy.problems(orgs, "id", "parent_organization_id").unionByName(catalog.problems(orgs, roots, dim).withColumnRenamed("organization", "node"))
    if wrong.limit(1).count():
        print(report.text_table(wrong), file=sys.stderr)
        return FOUND
    print(site.build(catalog.public_sources(orgs, sources, roots, dim), catalog.REGIONS, a.output or "dist/site"))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None, parser=None) -> int:
    """`parser` reads PDF files for the commands that need their texts; none is shipped."""
    try:
        a = _parser().parse_args(argv)
    except SystemExit as e:
        return USE if e.code else 0
    try:
        return _run(a, spark or SparkSession.builder.getOrCreate(), parser)
    except (BadUse, OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return USE if isinstance(e, BadUse) else FOUND


if __name__ == "__main__":
    sys.exit(main())
