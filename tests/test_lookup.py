"""Lookups of many patterns and searches in tasks, against plain loops; what they send between tasks."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldsieve.operators import lookup, patterns
from fieldsieve.plans import registered


@pytest.mark.parametrize("bits", [8, 20, 63])
def test_windows_find_what_a_plain_loop_finds(bits):
    random.seed(bits)
    word = lambda n: "".join(random.choice("abé😀") for _ in range(n))
    asked = list({(random.choice("gh"), word(random.choice([1, 2, 3, 7, 15, 40]))) for _ in range(60)})
    texts = [(random.choice("ghx"), word(random.randint(0, 30)) + random.choice(["", "\0", "zz"]) + random.choice(asked)[1]) for _ in range(150)] + [("g", "")]
    finder = lookup.Finder([p for _, p in asked], [g for g, _ in asked], bits)
    text, pattern = finder.find([x for _, x in texts], [g for g, _ in texts])
    want = {(i, k) for i, (g, x) in enumerate(texts) for k, (h, p) in enumerate(asked) if g == h and p in x}
    assert set(zip(text.tolist(), pattern.tolist())) == want and len(want) > 100


def test_patterns_that_are_alike_send_one_row(spark):
    """What moves between tasks are texts and patterns; joins moved a row for each gram, and one for each pattern and text."""
    plan = registered.pattern_index(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Join" not in plan and plan.count("MapInArrow") > 0


def test_totals_of_searches(spark, monkeypatch):
    random.seed(4)
    texts = [(k * 3 - 100, "".join(random.choice("abcd ") for _ in range(random.randint(0, 30)))) for k in range(300)] + [(5000, None)]
    asked = [["a"], ["b", "cd"], ["a", "b", "c", "d"], ["zz", "a"], [], None, ["", "dd"], ["cd", "b", "b"]] * 3
    monkeypatch.setattr(patterns, "TOGETHER", 2)
    t, q = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(list(enumerate(asked)), "query_id long, terms array<string>")
    want = {}
    for k, terms in enumerate(asked):
        some = [w for w in terms or [] if w]
        ids = [i for i, x in texts if x and some and all(w in x for w in some)]
        want |= {k: (len(ids), sum(ids))} if ids else {}
    assert {r.query_id: (r.n, r.total) for r in patterns.search_totals(t, q).collect()} == want and len(want) == 15
    pairs = {}
    for r in patterns.search_many(t, q).collect():
        pairs.setdefault(r.query_id, []).append(r.id)
    assert {k: (len(x), sum(x)) for k, x in pairs.items()} == want


def test_titles_are_compared_once_with_patterns_that_are_alike(spark, monkeypatch):
    asked, whole = [], patterns.matches
    monkeypatch.setattr(patterns, "matches", lambda texts, some: asked.append(some) or whole(texts, some))
    p = spark.createDataFrame([(k, "s", "the", False) for k in range(50)] + [(99, "s", "no", True)], "pattern_id long, grp string, pattern string, excludes boolean")
    got = patterns.title_reasons(spark.createDataFrame([(1, "s", "the one"), (2, "s", "no, the"), (3, "s", "x"), (4, "t", "x")], "id long, grp string, text string"), p)
    assert asked[0].count() == 2 and [r.reason for r in got.orderBy("id").collect()] == [None, patterns.EXCLUDED, patterns.NOT_INCLUDED, None]


def test_texts_go_to_the_patterns_of_their_group_alone(spark, monkeypatch):
    """Every text went to every slice of the patterns of all groups, and every pattern to every part of the texts."""
    def arrived(make):
        return lambda batches: (b.select(["id", "pattern_id"]) for b in batches)

    monkeypatch.setattr(patterns, "TOGETHER", 50)
    texts = spark.range(4000).selectExpr("id", "concat('g', IF(id % 2 = 0, 0, id % 40)) AS grp", "'abcdef' AS text")
    asked = spark.range(1000).selectExpr("id AS pattern_id", "concat('g', id % 40) AS grp", "concat('x', id) AS pattern")
    nobody = spark.range(2000).selectExpr("id AS pattern_id", "'nobody' AS grp", "concat('x', id) AS pattern")
    with monkeypatch.context() as m:
        m.setattr(lookup, "by_cell", arrived)
        sent = patterns.matches(texts, asked.union(nobody)).selectExpr("count(id) AS n", "count(pattern_id) AS m").first()
    assert sent.n == 4000 and 500 < sent.m < 1000
    found = patterns.matches(texts, asked.union(nobody).union(spark.createDataFrame([(9001, "g0", "cd"), (9002, "g1", "abcdef"), (9003, "g1", "zz")], asked.schema)))
    assert {(r.pattern_id, r.n) for r in found.groupBy("pattern_id").agg(F.count("*").alias("n")).collect()} == {(9001, 2000), (9002, 100)}


def test_bits_of_all_patterns_make_one_row(spark):
    random.seed(8)
    word = lambda n: "".join(random.choice("abc") for _ in range(n))
    texts = [(k, random.choice(["g", "h", None]), word(random.randint(0, 12))) for k in range(400)]
    asked = [(1 << k % 5, random.choice(["g", "h", None]), word(random.randint(0, 4))) for k in range(40)]
    want = {}
    for i, g, x in texts:
        for b, h, p in asked:
            if p and g == h and p in x:
                want[i] = want.get(i, 0) | b
    rows = patterns.matches(spark.createDataFrame(texts, "id long, grp string, text string"), spark.createDataFrame(asked, "bits long, grp string, pattern string")).collect()
    assert {r.id: r.bits for r in rows} == want and len(rows) == len(want) > 200


def test_small_and_large_groups_equal_a_plain_loop(spark, monkeypatch):
    random.seed(11)
    monkeypatch.setattr(patterns, "TOGETHER", 60)
    word = lambda n: "".join(random.choice("abc") for _ in range(n))
    group = lambda: random.choice([None, "", "big", "big", "texts only", *(f"g{k}" for k in range(300))]) if random.random() < 0.5 else f"g{random.randrange(300)}"
    texts, asked = [(k, group(), word(8)) for k in range(1500)], [(k, g, word(random.randint(1, 4))) for k in range(900) if (g := group()) != "texts only"]
    for of in (texts, [t for t in texts if (t[1] or "").startswith("g")]):
        want = {(i, k) for i, g, x in of for k, h, p in asked if g == h and p in x}
        rows = patterns.matches(spark.createDataFrame(of, "id long, grp string, text string"), spark.createDataFrame(asked, "pattern_id long, grp string, pattern string")).collect()
        assert len(rows) == len(want) > 500 and {(r.id, r.pattern_id) for r in rows} == want


def test_a_text_is_looked_up_once_for_all_searches(spark, monkeypatch):
    """Texts went to every slice of the queries and were looked up in each, however few different terms these had."""
    monkeypatch.setattr(patterns, "TOGETHER", 2)
    seen, whole = [], patterns._as_one
    monkeypatch.setattr(patterns, "_as_one", lambda *a: seen.append(whole(*a)) or seen[-1])
    texts = spark.range(300).selectExpr("id", "concat('ab', id % 7, 'cd', id % 5) AS text")
    asked = spark.range(60).selectExpr("id AS query_id", "array('ab', concat('b', id % 4), concat('d', id % 3)) AS terms")
    got = {r.query_id: (r.n, r.total) for r in patterns.search_totals(texts, asked).collect()}
    want = {}
    for q in range(60):
        ids = [k for k in range(300) if k % 7 == q % 4 and k % 5 == q % 3]
        want |= {q: (len(ids), sum(ids))} if ids else {}
    assert got == want and len(got) == 60
    of, _, cells = seen[0]
    assert of.selectExpr("max(size(cells))").first()[0] == 1
    many = spark.range(60).selectExpr("id AS query_id", "array(concat('ab', id % 7), concat('d', id), concat('x', id)) AS terms")
    assert patterns.search_totals(texts, many).count() == 0 and seen[-1][0].selectExpr("max(size(cells))").first()[0] > 10


@pytest.mark.parametrize("words", [1, 4, 16])
def test_counts_by_words_equal_a_plain_loop(monkeypatch, words):
    random.seed(words)
    monkeypatch.setattr(lookup, "WORDS", words)
    monkeypatch.setattr(lookup, "AT_ONCE", 40)
    monkeypatch.setattr(lookup, "CHARACTERS", 300)
    word = lambda n: "".join(random.choice("abé😀") for _ in range(n))
    texts = [word(random.choice([1, 9, 40, 200])) for _ in range(701)]
    ids = [random.choice([-1, 1]) * random.randrange(1 << 62) >> random.choice([0, 60]) for _ in texts]
    asked = [sorted({word(random.randint(1, 4)) for _ in range(random.randint(1, 4))}) for _ in range(80)] + [["zz", "a"], ["a" * 30]]
    work = lookup.Totals()
    rows = pa.RecordBatch.from_pydict({"query_id": list(range(len(asked))), "terms": asked})
    for k in range(0, len(asked), 30):
        work.ask(rows.slice(k, 30))
    work.begin()
    batch = pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "text": texts})
    for k in (0, 1, 70, 300):
        end = {0: 1, 1: 70, 70: 300, 300: 701}[k]
        assert not list(work.feed(batch.slice(k, end - k)))
    found = {q: [i for i, x in zip(ids, texts) if all(w in x for w in terms)] for q, terms in enumerate(asked)}
    wrapped = lambda n: (n + (1 << 63)) % (1 << 64) - (1 << 63)
    got = pa.Table.from_batches(work.finish()).to_pylist()
    assert {r["query_id"]: (r["n"], r["total"]) for r in got} == {q: (len(x), wrapped(sum(x))) for q, x in found.items() if x} and 40 < len(got) < 82
