"""Incremental collection of all sources at once: period, first-wins, anti-join, limit, breaker, funnel, commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.dates import effective_since
from ..operators.dedup import first_wins
from ..operators.once import Call, in_waves
from ..operators.rules import NOT_ADVANCED, commit_reason, new_candidates, period_state
from ..operators.select import breaker, group_breaker, limit_new
from ..sources.files import upsert_state
from .check import judged_candidates

WRITE_FAILED = "Failed to write collection state."


def periods(sources: DataFrame, state: DataFrame, manual: Column | None = None) -> DataFrame:
    """Each source with `since`; sources without a state begin at their initial date."""
    last = state.select("source_id", "last_successful_check_at")
    since = effective_since(F.col("last_successful_check_at"), F.col("initial_since").cast("date"), F.lit(None).cast("date") if manual is None else manual)
    return sources.join(last, "source_id", "left").withColumn("since", since)


def limited(candidates: DataFrame, limit: int) -> DataFrame:
    """Candidates in the period, each URL of a source once, with period and state: known, processed (to be analysed) or remaining."""
    rows = first_wins(candidates, ["source_id", "url"], ["pos"])
    rows = rows.withColumn("period", period_state(F.col("published"), F.col("since"), F.col("run_date")))
    return limit_new(rows.filter("period <> 'out'"), ["source_id"], ["pos"], F.col("is_new"), limit)


def process(candidates: DataFrame, limit: int, place: str | None = None) -> DataFrame:
    """Candidates (source_id, pos, url, published, since, run_date, is_new, limit_hit) with period, state and started.

    The breaker looks at rows that are handed to the analyzer only. `place` names the column of the source's place in a
    batch: no source behind the first one that hits the limit is started. Without it each source is a run of its own.
    """
    rows = limited(candidates, limit)
    hit = (F.col("state") == "processed") & F.col("limit_hit")
    rows = breaker(rows, ["source_id"], ["pos"], hit)
    return rows if place is None else group_breaker(rows, place, hit & F.col("started"))


def funnel(processed: DataFrame, failed: Column, write: bool = True, manual: bool = False) -> DataFrame:
    """source_id, in_period, new, processed, remaining, failed, reason, advanced of sources with a row in the period, each a run of its own; `batch` takes all sources."""
    worked = (F.col("state") == "processed") & F.col("started")
    rows = processed.groupBy("source_id").agg(
        F.count("*").alias("in_period"), F.count_if("is_new").alias("new"), F.count_if(worked).alias("processed"), F.count_if(F.col("state") == "remaining").alias("remaining"),
        F.count_if(worked & failed).alias("failed"), F.max(worked & F.col("limit_hit")).alias("limit_hit"),
    )
    reason = commit_reason(F.col("limit_hit"), F.lit(write), F.lit(manual), F.col("failed"), F.col("remaining"))
    return rows.withColumn("reason", reason).withColumn("advanced", reason.isNull()).drop("limit_hit")


def batch(sources: DataFrame, candidates: DataFrame, limit: int, failed: Column, write: bool = True, manual: bool = False) -> DataFrame:
    """source_id, place, in_period, new, processed, created, previewed, duplicates, failed, remaining, state, reason, advanced of each source that a batch runs.

    `sources` (source_id, place, failure) are run in the order of their places, which differ. One with a `failure` gives no
    candidates and keeps its state; one without candidates in the period is finalized as any other. The first usage limit
    ends the batch: later candidates and sources aren't looked at, and such sources have no row.
    """
    rows = process(candidates.join(sources.filter("failure IS NULL").select("source_id"), "source_id", "left_semi"), limit)
    started, state = F.col("started"), F.col("state")
    worked = started & (state == "processed")
    bad = F.coalesce(failed, F.lit(False)) | (worked & F.coalesce("limit_hit", F.lit(False)))
    counts = rows.groupBy("source_id").agg(
        F.count("*").alias("in_period"), F.count_if(started & F.col("is_new")).alias("new"), F.count_if(worked).alias("processed"), F.count_if(worked & ~bad & F.lit(write)).alias("created"),
        F.count_if(worked & ~bad & F.lit(not write)).alias("previewed"), F.count_if(started & (state == "known") & ~bad).alias("duplicates"),
        F.count_if(started & (state != "remaining") & bad).alias("failed"), F.count_if(started & (state == "remaining")).alias("remaining"), F.max(worked & F.col("limit_hit")).alias("limit_hit"),
    )
    numbers = [c for c in counts.columns if c not in ("source_id", "limit_hit")]
    out = sources.select("source_id", "place", "failure").join(counts, "source_id", "left").fillna(0, numbers).fillna(False, ["limit_hit"]).withColumn("started", F.lit(True))
    out = group_breaker(out, "place", F.col("limit_hit")).filter("started")
    reason = F.coalesce("failure", commit_reason(F.col("limit_hit"), F.lit(write), F.lit(manual), F.col("failed"), F.col("remaining")))
    status = F.when(F.col("failure").isNotNull(), "Failed").when(reason.isNull(), "Advanced").otherwise("Not advanced")
    return out.select("source_id", "place", *numbers, status.alias("state"), reason.alias("reason"), reason.isNull().alias("advanced"))


def batch_totals(sources: DataFrame, outcomes: DataFrame) -> DataFrame:
    """selected, run, stopped and the sums of what `batch` gives, in one row."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("created", "previewed", "duplicates", "failed", "remaining")]
    stopped = F.coalesce(F.max(F.coalesce(F.col("reason") == NOT_ADVANCED[0], F.lit(False)) & (F.col("state") != "Failed")), F.lit(False))
    return sources.agg(F.count("*").alias("selected")).crossJoin(outcomes.agg(F.count("*").alias("run"), stopped.alias("stopped"), *sums))


def collected(sources: DataFrame, orgs: DataFrame, fetched: DataFrame, state: DataFrame, sink: DataFrame, run_at: Column, manual: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(sources, candidates) for `batch`: what a run reads, without what the sink has.

    Sources (id, place and their settings) come with `failure` where their scan failed or no row is usable, and with `collected` and
    `unique` counts; candidates with period bounds and is_new. The sink (official_url) is looked up by URL, and by https for http.
    """
    judged = judged_candidates(sources, orgs, fetched)
    usable = judged.filter("pos IS NOT NULL AND exclude_reason IS NULL").select("source_id", "pos", "title", "url", F.col("published_at").alias("published"))
    counts = judged.groupBy("source_id").agg(F.max("scan_error").alias("scan_error"), F.count_if(F.col("pos").isNotNull() & F.col("exclude_reason").isNull()).alias("collected"))
    named = periods(sources.withColumn("source_id", F.col("id")), state, manual)
    unique = usable.groupBy("source_id").agg(F.count_distinct("url").alias("unique"))
    out = named.join(counts, "source_id", "left").join(unique, "source_id", "left").fillna(0, ["collected", "unique"])
    empty = F.coalesce("allow_empty_candidates", F.lit(False)) & (F.coalesce("scan_error", F.lit("")) == "no match")
    failure = F.when(~empty & F.col("scan_error").isNotNull(), F.col("scan_error")).when(~empty & (F.col("collected") == 0), "no usable candidate")
    new = new_candidates(usable.select("url").distinct(), sink, "url", "official_url").withColumn("is_new", F.lit(True))
    rows = usable.join(new, "url", "left").join(out.select("source_id", "since"), "source_id")
    rows = rows.withColumns({"is_new": F.coalesce("is_new", F.lit(False)), "run_date": F.to_date(run_at)})
    return out.select("source_id", "place", failure.alias("failure"), "since", "collected", "unique"), rows


def run(sources: DataFrame, candidates: DataFrame, results: DataFrame, limit: int, write: bool = True, manual: bool = False) -> DataFrame:
    """What `batch` gives of `collected` sources and candidates, with collected and unique.

    `results` (source_id, url, ok, limit_hit) is what the analyzer and the sink say of candidates; one that isn't there went well.
    """
    said = results.select("source_id", "url", (~F.col("ok")).alias("bad"), "limit_hit")
    rows = candidates.join(said, ["source_id", "url"], "left").fillna(False, ["bad", "limit_hit"])
    return batch(sources, rows, limit, F.col("bad"), write, manual).join(sources.select("source_id", "collected", "unique"), "source_id")


def run_in_waves(sources: DataFrame, candidates: DataFrame, call: Call, limit: int, path: str, size: int, write: bool = True, manual: bool = False) -> DataFrame:
    """`run`, where `call` is asked for candidates in the order of sources and places, `size` at once, and no longer after a used-up limit.

    `call` maps rows (source_id, url, place, pos and what else candidates have) to (source_id, url, ok, limit_hit). What it said is at `path`, and a run
    that was killed goes on from there. A null `limit_hit` is none, a null `ok` a failure.
    """
    places = sources.filter("failure IS NULL").select("source_id", "place")
    work = limited(candidates, limit).filter("state = 'processed'").join(places, "source_id")
    said = lambda rows: call(rows).select("source_id", "url", F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("limit_hit", F.lit(False)).alias("limit_hit"))
    results = in_waves(work, ["place", "pos"], ["source_id", "url"], said, path, size)
    return run(sources, candidates, results.filter("started").select("source_id", "url", "ok", "limit_hit"), limit, write, manual)


def commit(spark: SparkSession, path: str, outcomes: DataFrame, run_at: Column) -> tuple[DataFrame, int]:
    """Writes the start of the run as the state of advanced sources. Returns the outcomes and the exit code.

    Where the state can't be written, no outcome is advanced and the code is 1, as it is with any failed candidate or source.
    """
    advanced = outcomes.filter("advanced").select("source_id", run_at.cast("timestamp").alias("last_successful_check_at"))
    code = outcomes.agg(F.coalesce(F.max(((F.col("failed") > 0) | (F.col("state") == "Failed")).cast("int")), F.lit(0)).alias("code")).first().code
    if not advanced.limit(1).count():
        return outcomes, code
    try:
        upsert_state(spark, path, advanced)
    except Exception:  # whatever keeps the state from being written is the outcome of each source
        lost = F.col("advanced")
        return outcomes.withColumns({"reason": F.when(lost, WRITE_FAILED).otherwise(F.col("reason")), "state": F.when(lost, "Not advanced").otherwise(F.col("state")), "advanced": F.lit(False)}), 1
    return outcomes, code
