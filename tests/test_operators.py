import math
import random

from pyspark.sql import functions as F

from fieldsieve.operators import analysis, dedup, hierarchy, rules, select


def test_slots_equal_the_loop(spark):
    random.seed(3)
    rows = [(g, k, random.choice("abc"), random.random() < 0.6, random.random() < 0.3) for g in range(60) for k in range(8)]
    rows = [(g, k, p, ok, not ok and bad) for g, k, p, ok, bad in rows]
    df = spark.createDataFrame(rows, "g int, k int, p string, ok boolean, bad boolean")
    got = {(r.g, r.k): (r.attempted, r.accepted) for r in select.slot_selection(df, ["g"], ["k"], F.col("ok"), F.col("bad"), "p", 3).collect()}
    for g in range(60):
        used, seen = 0, set()
        for _, k, p, ok, bad in (r for r in rows if r[0] == g):
            want = (used < 3, False)
            if used < 3:
                if bad:
                    used += 1
                elif ok and p not in seen:
                    seen.add(p)
                    used += 1
                    want = (True, True)
            elif ok:
                seen.add(p)
            assert got[g, k] == want


def fill(lengths, total, most):
    caps = [min(x, most) for x in lengths]
    if sum(caps) <= total:
        return caps
    out, left, rest = {}, set(range(len(caps))), total
    while left:
        share = rest // len(left)
        done = [k for k in left if caps[k] <= share]
        if not done:
            for n, k in enumerate(sorted(left)):
                out[k] = share + (n < rest - share * len(left))
            break
        for k in done:
            out[k] = caps[k]
            rest -= caps[k]
            left.discard(k)
    return [out[k] for k in range(len(caps))]


def test_water_filling_equals_the_loop(spark):
    random.seed(4)
    groups = [[random.choice([0, 5, 10, 50, random.randint(0, 200)]) for _ in range(random.randint(1, 7))] for _ in range(150)]
    df = spark.createDataFrame([(g, k, n) for g, x in enumerate(groups) for k, n in enumerate(x)], "g int, k int, n long")
    got = {(r.g, r.k): r.budget for r in select.water_fill(df, ["g"], ["k"], "n", 101, 60).collect()}
    for g, x in enumerate(groups):
        assert [got[g, k] for k in range(len(x))] == fill(x, 101, 60)


def test_limit_breaker_and_runs(spark):
    df = spark.createDataFrame([("a", k, k in (1, 2, 4, 5)) for k in range(6)], "g string, k int, new boolean")
    states = [r.state for r in select.limit_new(df, ["g"], ["k"], F.col("new"), 2).orderBy("k").collect()]
    assert states == ["known", "processed", "processed", "known", "remaining", "remaining"]
    assert [r.started for r in select.breaker(df, ["g"], ["k"], F.col("k") == 2).orderBy("k").collect()] == [True] * 3 + [False] * 3
    runs = dedup.islands(df.filter("new"), ["g"], "k").orderBy("first_at").collect()
    assert [(r.first_at, r.last_at, r.length) for r in runs] == [(1, 2, 2), (4, 5, 2)]


def test_each_row_has_the_first_reason(spark):
    rows = [
        (0, "Good", "https://a.jp/1"), (1, "Good again", "https://a.jp/1#x"), (2, "Out", "https://b.jp/1"), (3, " ", "https://a.jp/2"), (4, "Self", "https://a.jp/list#top"), (5, "Skip", "https://a.jp/3"), (6, "Skip", "https://a.jp/3"), (7, "Bad", "::"), (8, "Other", "https://a.jp/9"),
    ]
    df = spark.createDataFrame([("s", *r, r[1].strip().lower(), "a.jp", "https://a.jp/list", ["good", "skip"], ["skip"]) for r in rows], "source_id string, pos int, title string, url string, norm_title string, domain string, source_url string, includes array<string>, excludes array<string>")
    got = {r.pos: r.exclude_reason for r in rules.judged(df).collect()}
    assert got == {0: None, 1: rules.REPEAT, 2: rules.EXTERNAL, 3: rules.MISSING, 4: rules.SELF, 5: rules.EXCLUDED, 6: rules.REPEAT, 7: rules.BAD_URL, 8: rules.NOT_INCLUDED}
    counts = {r.reason: (r.n, r.first_pos) for r in rules.exclusion_counts(rules.judged(df)).collect()}
    assert counts[rules.REPEAT] == (2, 1)


def test_new_candidates_fall_back_to_https_only(spark):
    probe = spark.createDataFrame([("http://a",), ("https://b",), ("http://c",), ("http://d",)], "url string")
    sink = spark.createDataFrame([("https://a",), ("http://b",), ("http://c",)], "official_url string")
    assert sorted(r.url for r in rules.new_candidates(probe, sink, "url", "official_url").collect()) == ["http://d", "https://b"]


def test_cycles_end(spark):
    orgs = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None), ("d", "c")], "id string, parent string")
    got = {(r.node, r.ancestor): r.depth for r in hierarchy.closure(orgs, "id", "parent").collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("b", "b"): 0, ("b", "a"): 1, ("c", "c"): 0, ("d", "d"): 0, ("d", "c"): 1}


def test_commit_reasons_in_order(spark):
    rows = [(True, False, True, 1, 1), (False, False, True, 1, 1), (False, True, True, 1, 1), (False, True, False, 1, 1), (False, True, False, 0, 1), (False, True, False, 0, 0)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, hit boolean, write boolean, manual boolean, failed int, remaining int")
    got = [r.reason for r in df.withColumn("reason", rules.commit_reason(*map(F.col, ("hit", "write", "manual", "failed", "remaining")))).orderBy("k").collect()]
    assert got == [*rules.NOT_ADVANCED, None]


def test_exact_sums():
    assert analysis.exact_sum([1e100, 1.0, -1e100]) == 1.0
    assert analysis.exact_sum([1e16, *[1.0] * 10]) == 10000000000000010
    assert math.copysign(1, analysis.exact_sum([])) == -1 and math.isnan(analysis.exact_sum([math.inf, -math.inf])) and analysis.exact_sum([1e308, 1e308, -1e308]) == 1e308


def test_choice_of_text():
    pages = [f"{k}. 業務内容\n" + "本文" * 200 for k in range(4)] + ["提出方法\n" + "定型" * 200 for _ in range(4)]
    text = "\n\n".join(pages)
    made, how, runs = analysis.choose_text(text, pages, 2000)
    assert how == "relevant_chunks" and len(made) <= 2000 and "業務内容" in made and runs >= 1
    assert analysis.choose_text("short", None, 10) == ("short", "full", 1)
    assert analysis.choose_text("x" * 50, None, 10)[1] == "fallback_truncate"
    assert analysis.choose_text("", None, 0) == ("", "full", 0)


def test_constraints_and_envelopes(spark):
    df = spark.createDataFrame([(True, ["行政DX"], "B", "medium", "r"), (False, ["その他", "行政DX"], "A", "high", " ")], "t boolean, c array<string>, rel string, con string, r string")
    got = [r[0] for r in df.select(analysis.analysis_issues(*map(F.col, ("t", "c", "rel", "con", "r")))).collect()]
    assert got == [[], ["categories_of_non_target", "other_is_exclusive", "relevance_of_non_target", "contact_of_non_target", "reason"]]
    raw = ["x", "[1]", '{"type":"a"}', '{"type":"result","subtype":"x"}', '{"type":"result","subtype":"success","is_error":true}', '{"type":"result","subtype":"success","is_error":false}', '{"type":"result","subtype":"success","is_error":false,"result":"{"}', '{"type":"result","subtype":"success","is_error":false,"result":"```json\\n{}\\n```"}']
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(raw)], "k int, raw string")
    assert [r.s for r in rows.withColumn("s", analysis.envelope_stage(F.col("raw"))).orderBy("k").collect()] == [1, 1, 2, 3, 4, 5, 7, 0]


def test_evidence_of_benchmark_passages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").filter("text IS NOT NULL")
    passages = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", F.col("text").alias("quote"))
    found = {(r.doc_id, r.item_id) for r in analysis.evidence_found(docs.select("doc_id").crossJoin(passages), docs, ["doc_id"]).filter("matched").select("doc_id", "item_id").collect()}
    texts, quotes = docs.collect(), passages.collect()
    where = {(x.doc_id, q.item_id): x.text.find(q.quote) for x in texts for q in quotes if q.quote in x.text}
    assert found >= set(where) and max(where.values()) > 1000 and len({item for _, item in where}) > 10


def test_evidence_is_searched_in_the_whole_text(spark, monkeypatch):
    from fieldsieve.plans import registered

    whole = analysis.evidence_found
    monkeypatch.setattr(analysis, "evidence_found", lambda quotes, texts, keys: whole(quotes, texts.withColumn("text", F.left("text", F.lit(40))), keys))
    short = registered.evidence_places(spark, "/root/testdata/sf0.001").filter("place <> 'other' AND NOT matched").count()
    monkeypatch.undo()
    assert short > 0 and registered.evidence_places(spark, "/root/testdata/sf0.001").filter("place <> 'other' AND NOT matched").count() == 0


def test_long_chains_and_broken_ones(spark):
    n = 300
    orgs = spark.createDataFrame([(f"n{k}", f"n{k - 1}" if k else None) for k in range(n)] + [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("lost", "nobody"), ("self", "self")], "id string, parent string")
    closed = hierarchy.closure(orgs, "id", "parent")
    assert closed.filter("node LIKE 'n%'").count() == n * (n + 1) // 2
    assert {r.ancestor: r.depth for r in closed.filter(f"node = 'n{n - 1}'").collect()} == {f"n{k}": n - 1 - k for k in range(n)}
    assert {r.ancestor: r.depth for r in closed.filter("node = 'd'").collect()} == {"d": 0, "a": 1, "b": 2, "c": 3}
    assert {(r.node, r.issue) for r in hierarchy.problems(orgs, "id", "parent").collect()} == {("a", "cycle"), ("b", "cycle"), ("c", "cycle"), ("d", "cycle"), ("self", "cycle"), ("lost", "unknown parent")}


def test_null_texts_and_clashing_names(spark):
    from fieldsieve.sources import html

    df = spark.createDataFrame([(1, None, "x"), (2, "short", "y"), (3, "long " * 50, "z")], "doc_id long, text string, c string").selectExpr("*", "1 AS _c", "'old' AS strategy")
    out = {r.doc_id: (r.sent_text, r.strategy) for r in analysis.chosen_texts(df, "text", 20).collect()}
    assert set(out) == {1, 2, 3} and out[1] == (None, "full") and out[2] == ("short", "full") and len(out[3][0]) <= 20
    names = "rn run least least_0 ok first seen slots slots_0 own cap sum fits left m k other early own_url is_list own_domain probe own_text own_quote title error date links page base_url".split()
    rows = spark.createDataFrame([("s", k, "a", f"https://a.jp/{k % 3}") for k in range(5)], "source_id string, pos int, p string, url string").withColumns({n: F.lit("mine") for n in names if n != "title"} | {"title": F.lit("T")})
    calls = {
        "first_wins": lambda df: dedup.first_wins(df, ["url"], ["pos"]), "flag_repeats": lambda df: dedup.flag_repeats(df, ["url"], ["pos"]), "slots": lambda df: select.slot_selection(df, ["source_id"], ["pos"], F.lit(True), F.lit(False), "p", 2),
        "fill": lambda df: select.water_fill(df, ["source_id"], ["pos"], "pos", 3, 2), "low": lambda df: select.drop_low_if_any(df, ["source_id"], "p"), "best": lambda df: select.best_by_class(df, ["source_id"], "p", ["pos"], 2),
        "first_rows": lambda df: select.first_rows(df, ["source_id"], ["pos"], 2), "new": lambda df: rules.new_candidates(df, df.limit(0).select(F.col("url").alias("u")), "url", "u"),
        "judged": lambda df: rules.judged(df.withColumns({"norm_title": F.lit("t"), "domain": F.lit("a.jp"), "source_url": F.lit("https://a.jp/"), "includes": F.array().cast("array<string>"), "excludes": F.array().cast("array<string>")})),
        "breaker": lambda df: select.group_breaker(df.withColumn("started", F.lit(True)), "pos", F.col("pos") > 3), "evidence": lambda df: analysis.evidence_found(df.withColumn("quote", F.lit("q")), spark.createDataFrame([(0, "q")], "pos int, text string"), ["pos"]),
        "documents": lambda df: html.documents(df.withColumn("html", F.lit("<title>T</title>" + "x" * 300)), url="url"), "titles": lambda df: html.titles(df.withColumn("html", F.lit("<title>T</title>"))),
    }
    for name, call in calls.items():
        got = call(rows)
        assert got.count() > 0 and all(r.rn == "mine" and r.own == "mine" for r in got.collect()), name


def test_null_and_hot_keys_of_repeats(spark):
    df = spark.createDataFrame([(0, None), (1, "a"), (2, None), (3, "a"), (4, "b")], "pos int, p string")
    assert {r.pos for r in dedup.flag_repeats(df, ["p"], ["pos"]).filter("input_duplicate").collect()} == {2, 3}


def test_exact_sums_of_groups(spark):
    rows = [("a", 1e100), ("a", 1.0), ("a", -1e100), ("b", math.nan), ("c", math.inf), ("c", -math.inf), ("d", 1e308), ("d", 1e308), ("d", -1e308), ("e", math.inf), ("f", -0.0), ("f", None), (None, 0.5), (None, 5e-324), ("g", 1e308), ("g", 1e308)]
    got = {r.k: r.total for r in analysis.exact_sums(spark.createDataFrame(rows, "k string, v double").repartition(3), ["k"], "v").collect()}
    assert got["a"] == 1.0 and math.isnan(got["b"]) and math.isnan(got["c"]) and got["d"] == 1e308 and got["e"] == got["g"] == math.inf and math.copysign(1, got["f"]) == -1 and got[None] == 0.5
    assert all(math.isnan(got[k]) if math.isnan(w) else got[k] == w for k in "abcdefg" for w in [analysis.exact_sum([v for x, v in rows if x == k and v is not None])])


def test_rules_of_an_analysis(spark):
    good = {"is_target": True, "document_type": "rfi", "problem_summary": "", "desired_state": "", "request_to_private_sector": "", "company_relevance": "A", "contact_recommendation": "high", "reason": "r"}
    df = spark.createDataFrame([tuple(good.values())], ", ".join(f"{k} {'boolean' if k == 'is_target' else 'string'}" for k in good))
    df = df.withColumn("evidence_quotes", F.array(F.struct(F.lit("html").alias("source_type"), F.lit("https://a.jp/").alias("source_url"), F.lit("q").alias("quote"))))
    issues = lambda d: d.select(analysis.output_issues(d)).first()[0]
    assert issues(df) == []
    bad = df.withColumns({"is_target": F.lit(None).cast("boolean"), "document_type": F.lit("x"), "desired_state": F.repeat(F.lit("a"), 2001), "company_relevance": F.lit("Z"), "reason": F.lit(" "), "evidence_quotes": F.expr("CAST(array() AS array<struct<source_type:string,source_url:string,quote:string>>)")})
    assert issues(bad) == ["is_target", "document_type", "desired_state", "company_relevance", "reason", "evidence_quotes"]
    assert issues(df.withColumn("evidence_quotes", F.array(F.struct(F.lit("doc").alias("source_type"), F.lit("https://a.jp/").alias("source_url"), F.lit("q").alias("quote"))))) == ["evidence_quote"]
    known = spark.range(1).select(analysis.analysis_issues(F.lit(True), F.array(F.lit("行政DX"), F.lit("nothing")), F.lit("A"), F.lit("high"), F.lit("r"))).first()[0]
    assert known == ["unknown_category"]
