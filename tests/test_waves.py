"""Calls are made once, stored as they end, and stop behind a used-up limit."""

import collections
import os
import uuid

import pytest
from pyspark.sql import functions as F

from fieldsieve.operators import once
from fieldsieve.operators.analysis import Analyzers, mock_analysis
from fieldsieve.plans import analyze, collection


def counting(folder, hits=(), dies_at=()):
    """An analyzer that leaves a file for each call; it dies at some ids while the file `dies` is there."""

    def run(frames):
        for df in frames:
            for i in df["id"]:
                if i in dies_at and os.path.exists(f"{folder}/dies"):
                    raise RuntimeError("killed")
                with open(f"{folder}/{i}.{uuid.uuid4().hex}", "w"):
                    pass
            df["limit_hit"], df["ok"] = df["id"].isin(list(hits)), ~df["id"].isin(list(hits))
            yield df[["id", "limit_hit", "ok"]]

    return lambda rows: rows.select("id").mapInPandas(run, "id long, limit_hit boolean, ok boolean")


def calls(folder):
    return collections.Counter(int(f.split(".")[0]) for f in os.listdir(folder) if f != "dies")


def work(spark, n):
    """Ids are not the order."""
    return spark.range(n).select("id", (F.lit(n) - F.col("id")).alias("place"), F.lit(0).alias("rank_"))


@pytest.mark.parametrize("hits,last", [((70,), 29), ((70, 3), 29), ((99,), 0), ((0,), 99), ((), 99)])
def test_waves_stop_behind_the_first_limit(spark, tmp_path, hits, last):
    seen = tmp_path / "seen"
    seen.mkdir()
    out = once.in_waves(work(spark, 100), ["place"], ["id"], counting(seen, hits), str(tmp_path / "store"), 16)
    rows = {r.id: r for r in out.collect()}
    end = min(100, (last // 16 + 1) * 16) if hits else 100
    assert calls(seen) == {i: 1 for i in range(99, 99 - end, -1)} and set(rows) == set(calls(seen))
    assert all(r.rank == 99 - i and r.wave == r.rank // 16 and r.started == (r.rank <= last) for i, r in rows.items())
    out.count()
    once.in_waves(work(spark, 3), ["place"], ["id"], counting(seen, hits), str(tmp_path / "store"), 16).collect()  # the store has all that is needed
    assert sum(calls(seen).values()) == end


def test_a_killed_run_goes_on(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    (seen / "dies").touch()
    run = lambda: once.in_waves(work(spark, 60), ["place"], ["id"], counting(seen, (5,), (30,)), str(tmp_path / "store"), 20)
    with pytest.raises(Exception, match="killed"):
        run().count()
    before = calls(seen)
    assert 20 <= sum(before.values()) < 40 and set(before.values()) == {1} and 30 not in before
    (seen / "dies").unlink()
    assert {r.id for r in run().collect()} == set(range(60)) == set(calls(seen))
    stored = {r.id for r in once.stored_results(spark, str(tmp_path / "store" / "results"), ["id"]).collect()}
    twice = [i for i, n in calls(seen).items() if n > 1]
    assert stored == set(range(60)) and len(twice) <= 4, twice  # at most what tasks of the killed job hadn't finished


def test_calls_once_and_empty_inputs(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    call, path = counting(seen), str(tmp_path / "store")
    assert once.called_once(work(spark, 0), ["id"], call, path).count() == 0
    assert once.called_once(work(spark, 5), ["id"], call, path).count() == 5
    assert once.called_once(work(spark, 9), ["id"], call, path).filter("id > 2").count() == 6 and calls(seen) == {i: 1 for i in range(9)}
    assert once.in_waves(work(spark, 0), ["place"], ["id"], call, str(tmp_path / "none"), 5).count() == 0


def test_numbered(spark):
    df = spark.range(1000).repartition(7).select((F.col("id") * 37 % 1000).alias("k"), F.lit("x").alias("at"))
    assert [(r.k, r.n) for r in once.numbered(df, ["k"], "n").collect() if r.k != r.n] == [] and once.numbered(df.limit(0), ["k"], "n").count() == 0


def test_an_analysis_is_made_once_a_document(spark, tmp_path):
    """Though its quotes are looked up in pages and attachments, and the result is read more than once."""
    seen = tmp_path / "seen"
    seen.mkdir()

    def provider(inputs):
        @F.udf("string")
        def told(i):
            with open(f"{seen}/{i}.{uuid.uuid4().hex}", "w"):
                pass
            return "x"

        return mock_analysis(inputs).withColumn("told", told.asNondeterministic()("doc_id"))

    known = Analyzers()
    known.register("counted", provider)
    docs = spark.range(5).select(F.col("id").alias("doc_id"), F.concat(F.lit("https://a.example/"), "id").alias("url"), F.lit("t").alias("title"), F.lit("本文の文章です。").alias("text"))
    pdfs = F.array().cast("array<struct<rank:int,url:string,text:string,strategy:string>>")
    path = str(tmp_path / "store")
    inputs = docs.withColumn("pdfs", pdfs)
    out = analyze.analyzed(inputs, "counted", known, path)
    assert out.count() == 5 and out.filter("told = 'x'").count() == 5 and calls(seen) == {i: 1 for i in range(5)}
    assert analyze.analyzed(inputs, "counted", known, path).count() == 5 and sum(calls(seen).values()) == 5


def test_a_batch_in_waves_equals_one_run(spark, tmp_path):
    """Rows as a run that knows all results beforehand, for limits in any source."""
    sources = spark.createDataFrame([(f"s{k}", k, "broken" if k == 2 else None, 9, 9) for k in range(6)], "source_id string, place int, failure string, collected int, unique int")
    rows = spark.range(180).select(
        F.concat(F.lit("s"), F.col("id") % 6).alias("source_id"), F.col("id").alias("pos"), F.concat(F.lit("u"), F.col("id") % 150).alias("url"), F.lit("2026-01-02").cast("date").alias("published"), F.lit("2026-01-01").cast("date").alias("since"),
        F.lit("2026-02-01").cast("date").alias("run_date"), (F.floor(F.col("id") / 6) % 3 > 0).alias("is_new"),
    )
    for hit in (None, "u25", "u100"):
        said = lambda x, hit=hit: x.select("source_id", "url", (F.col("pos") % 11 != 0).alias("ok"), F.lit(False if hit is None else None).alias("none"), (F.col("url") == F.lit(hit or "")).alias("limit_hit"))
        got = collection.run_in_waves(sources, rows, said, 20, str(tmp_path / f"store-{hit}"), 7).orderBy("place").collect()
        want = collection.run(sources, rows, said(rows.filter("is_new AND pos < 150")).select("source_id", "url", "ok", "limit_hit"), 20).orderBy("place").collect()
        assert got == want and len(got) == {None: 6, "u25": 2, "u100": 5}[hit]
