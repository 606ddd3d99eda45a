"""Keys that a great part of the rows have: empty texts, copies, near copies of a template, a line of all documents, centres of links."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldsieve.llm import components, near_dedup, quality_rules, skew


def corpus():
    random.seed(2)
    vocab = [f"w{k}" for k in range(500)]
    template = [random.choice(vocab) for _ in range(120)]
    rows = [(k, "" if k % 2 else None) for k in range(150)] + [(1000 + k, "copy of one text that many have " * 3) for k in range(100)]
    for k in range(150):
        words = list(template)
        for _ in range(random.choice([0, 1, 2, 3, 9])):
            words[random.randrange(120)] = random.choice(vocab)
        rows.append((2000 + k, " ".join(words)))
    return rows + [(3000 + k, " ".join(random.choice(vocab) for _ in range(80))) for k in range(60)]


def sets(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def linked(rows, k, num):
    found, label = [(i, sets(t, k)) for i, t in rows], {i: i for i, _ in rows}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    n_links = 0
    for a, (i, x) in enumerate(found):
        for j, y in found[a + 1 :]:
            if x and y and 100 * len(x & y) >= num * len(x | y):
                n_links += 1
                lo, hi = sorted((top(i), top(j)))
                label[hi] = lo
    return {i: top(i) for i in label}, n_links


@pytest.mark.parametrize("share", [1 / 65536, 1 / 8])
def test_near_duplicates_with_hot_groups(spark, monkeypatch, share):
    """All documents are linked as brute force links them, so every pair above the threshold is found (recall 1), with keys broadcast and dealt."""
    monkeypatch.setattr(skew, "SHARE", share)
    monkeypatch.setattr(skew.with_value, "__defaults__", (share,))
    df = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(5)
    for k, num in ((3, 85), (5, 80)):
        got = near_dedup.near_duplicates(df, k, num).collect()
        want, n_links = linked(corpus(), k, num)
        assert {r.doc_id: r.component_id for r in got} == want and n_links > 5000 and len(got) == len(want)
        copies = {r.doc_id: r.n_copies for r in got}
        assert all(copies[1000 + i] == 100 for i in range(100)) and all(copies[i] == 1 for i in range(150))


def test_no_task_has_the_hot_rows(spark, monkeypatch):
    """20,000 rows, of which most have one key: joined where they are, every partition has its share."""
    monkeypatch.setattr(skew.with_value, "__defaults__", (1 / 64,))
    rows = spark.range(20000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("key")).repartition(8)
    table = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("value"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = skew.with_value(rows, table, ["key"], "value", "n", ["id"])
        sizes = sorted(r.n for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())
        assert sum(sizes) == 20000 and sizes[-1] < 3 * sizes[len(sizes) // 2]
        assert out.filter("value <> CASE WHEN key = 'hot' THEN 19999 ELSE id END").count() == 0 and out.filter("value IS NULL").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was[0])
        spark.conf.set("spark.sql.adaptive.enabled", was[1])


def test_a_star_and_a_chain_of_links(spark, monkeypatch):
    monkeypatch.setattr(skew.with_value, "__defaults__", (1 / 16,))
    star = [(5, k) for k in range(100, 400)] + [(k, k + 1) for k in range(1000, 1060)] + [(3, 399), (None, 1), (7, 7), (400, 1030)]
    got = dict(components.connected_components(spark.createDataFrame(star, "a long, b long")).collect())
    assert got == {3: 3, 5: 3} | {k: 3 for k in range(100, 400)} | {k: 400 for k in [*range(1000, 1061), 400]} | {7: 7}


def test_a_line_that_all_documents_have(spark, monkeypatch):
    for share in (1 / 65536, 1 / 2):
        monkeypatch.setattr(skew.with_value, "__defaults__", (share,))
        rows = [(k, f"Common line of all\nown words number {'x' * (k % 50 + 1)}", None if k % 4 == 0 else f"s{k % 3}") for k in range(400)]
        got = {r.doc_id: r.removed_chars for r in quality_rules.line_frequency_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_words=1).collect()}
        first, seen = {}, Counter((s, len(t)) for _, t, s in rows)
        for k, _, s in rows:
            first.setdefault(s, k)
        own = {}
        for k, t, s in rows:
            own.setdefault((s, t), k)
        often = {x for x, n in Counter((s, t) for _, t, s in rows).items() if n > 20}
        assert seen and got == {k: (0 if first[s] == k else 18) + (len(t) - 19 if (s, t) in often and own[s, t] != k else 0) for k, t, s in rows}
