"""Analysis of documents with attachments, over all documents at once: rank, slots, repeats, budgets, text choice, analyzer, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import fingerprint, for_match, head_tail, priority
from ..operators.analysis import Analyzers, choose_text, evidence_found
from ..operators.once import called_once, new_store
from ..operators.select import drop_low_if_any, slot_selection, water_fill
from ..sources.config import Limits


def _pages(texts: DataFrame) -> Column:
    return (F.col("page_texts") if "page_texts" in texts.columns else F.lit(None)).cast("array<string>").alias("page_texts")


def attachments(links: DataFrame, texts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Accepted attachments with class, rank and budget. links: (doc_id, pos, url, text); texts: (url, body, error), and page_texts where pages are known.

    A fragment doesn't make a link different; the first text of a link counts. Passwords and empty texts take no slot.
    """
    one = links.withColumn("bare", F.regexp_replace("url", "#.*$", ""))
    one = one.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "bare").orderBy("pos"))).filter("_k = 1").drop("_k")
    name = F.regexp_extract("bare", "([^/]*)$", 1)
    ranked = drop_low_if_any(one.withColumn("class", priority(for_match(F.col("text")), for_match(name), for_match(F.col("bare")))), ["doc_id"], "class")
    order = F.when(F.col("class") == "high", 0).when(F.col("class") == "medium", 1).when(F.col("class") == "other", 2).otherwise(3)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(order, "pos")))
    got = ranked.join(texts.select(F.col("url").alias("bare"), "body", "error", _pages(texts)), "bare", "left").withColumn("print", fingerprint(F.coalesce("body", F.lit(""))))
    ok = F.col("error").isNull() & (F.coalesce(F.length(F.trim("body")), F.lit(0)) > 0)
    failed = F.col("error").isNotNull() & ~F.col("error").isin("password_protected", "no_text")
    taken = slot_selection(got, ["doc_id"], ["rank"], ok, failed, "print", limits.max_pdfs).filter("accepted").withColumn("length", F.length("body"))
    return water_fill(taken, ["doc_id"], ["rank"], "length", limits.pdf_total, limits.per_pdf).select("doc_id", "rank", "bare", "class", "body", "length", "budget", "page_texts")


def prepared(docs: DataFrame, accepted: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """docs (doc_id, url, text) with the text that is sent, attachments as an array, and characters before and after."""

    @F.pandas_udf("sent string, strategy string, runs int")
    def pick(body, pages, budget):
        import pandas as pd

        return pd.DataFrame([choose_text(b or "", None if p is None else list(p), int(n)) for b, p, n in zip(body, pages, budget)], columns=["sent", "strategy", "runs"])

    sent = accepted.withColumn("p", pick("body", _pages(accepted), "budget"))
    lists = sent.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("bare").alias("url"), F.col("p.sent").alias("text"), F.col("p.strategy").alias("strategy")))).alias("pdfs"), F.sum("length").alias("pdf_characters"), F.sum(F.length("p.sent")).alias("pdf_sent"))
    rows = docs.join(lists, "doc_id", "left").withColumn("html_characters", F.length("text")).withColumn("text", head_tail(F.col("text"), limits.html))
    return rows.fillna(0, ["pdf_characters", "pdf_sent"]).withColumn("total_sent", F.length("text") + F.col("pdf_sent"))


def analyzed(inputs: DataFrame, provider: str = "mock", analyzers: Analyzers | None = None, path: str | None = None) -> DataFrame:
    """The provider's fields, and matched: how many quotes the named text holds.

    The provider is called once a document: its results are stored, at `path` if that is given, where a later run finds them, and read from there.
    """
    made = called_once(inputs, ["doc_id"], (analyzers or Analyzers()).get(provider), path or new_store(inputs.sparkSession, "analyses"))
    quotes = made.select("doc_id", F.posexplode("evidence_quotes").alias("n", "q")).select("doc_id", "n", "q.source_type", "q.source_url", "q.quote")
    page = inputs.select("doc_id", F.lit("html").alias("source_type"), F.col("url").alias("source_url"), "text")
    pdfs = inputs.select("doc_id", F.explode("pdfs").alias("p")).select("doc_id", F.lit("pdf").alias("source_type"), F.col("p.url").alias("source_url"), F.col("p.text").alias("text"))
    found = evidence_found(quotes, page.unionByName(pdfs), ["doc_id", "source_type", "source_url"])
    return made.join(found.groupBy("doc_id").agg(F.count_if("matched").alias("matched"), F.count("*").alias("quotes")), "doc_id", "left")
