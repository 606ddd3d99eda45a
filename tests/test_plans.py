import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldsieve import cli
from fieldsieve.operators import analysis, report, sink
from fieldsieve.plans import analyze, catalog, check, collection, site
from fieldsieve.sources import config, pdf, registry

from .test_sources import REGISTRY

CHECKED = """
version: 1
organizations:
  - {id: o, name: O, organization_type: prefecture, official_domain: o.jp, enabled: true, prefecture: 東京都}
sources:
  - {id: feed, organization_id: o, name: Feed, url: "https://o.jp/f", collector_type: rss, source_category: rfi, priority: high, enabled: true, category_includes: [防災]}
  - {id: list, organization_id: o, name: List, url: "https://o.jp/l", collector_type: list_page, source_category: rfi, priority: high, enabled: true, link_selector: "#m a", title_excludes: [終了]}
  - {id: fix, organization_id: o, name: Fixed, url: "https://o.jp/x", collector_type: single_page, source_category: rfi, priority: high, enabled: true}
  - {id: hand, organization_id: o, name: Hand, url: "https://o.jp/h", collector_type: manual, source_category: rfi, priority: high, enabled: false}
  - {id: bare, organization_id: o, name: Bare, url: "https://o.jp/b", collector_type: list_page, source_category: rfi, priority: high, enabled: true, link_selector: ".none"}
"""
FEED = "<rss><channel>" + "".join(f"<item><title>T{k}</title><link>https://o.jp/{k}</link><pubDate>Wed, 05 Aug 2026 00:00:00 GMT</pubDate><category>{c}</category></item>" for k, c in enumerate(["防災・安全", "他", "防災"])) + "</channel></rss>"
LIST = '<div id="m"><ul><li>2026年8月5日<a href="/a">One</a></li><li><a href="/a#x">One again</a></li><li><a href="https://else.com/">Out</a></li><li><a href="/c"> </a></li><li><a href="/l">Self</a></li><li><a href="/d">終 了</a></li></ul></div>'


def test_source_check(spark):
    orgs, sources = registry.load(spark, CHECKED)
    fetched = spark.createDataFrame([("feed", "https://o.jp/f", FEED), ("list", "https://o.jp/l", LIST), ("bare", "https://o.jp/b", LIST)], "source_id string, base_url string, body string")
    results = check.check(sources, orgs, fetched)
    got = {r.source_id: (r.status, r.raw, r.valid, r.usable, r.latest) for r in results.collect()}
    day = dt.date(2026, 8, 5)
    assert got == {"feed": ("ok", 3, 3, 2, day), "list": ("warning", 6, 3, 1, day), "fix": ("ok", 1, 1, 1, None), "hand": ("unsupported", 0, 0, 0, None), "bare": ("error", 0, 0, 0, None)}
    assert tuple(report.histogram(results).first()) == (2, 1, 1, 1) and sink.exit_code(results, False).first()[0] == 1
    assert sink.exit_code(results.filter("source_id = 'hand'"), False).first()[0] == 0 and sink.exit_code(results.filter("source_id = 'hand'"), True).first()[0] == 1


def test_analysis_of_a_page(spark):
    docs = spark.createDataFrame([(1, "https://o.jp/1", "This page says enough about the need.")], "doc_id long, url string, text string")
    links = spark.createDataFrame([(1, 0, "https://o.jp/a.pdf#1", "様式"), (1, 1, "https://o.jp/b.pdf", "仕様書"), (1, 2, "https://o.jp/b.pdf#p", "again"), (1, 3, "https://o.jp/c.pdf", "概要"), (1, 4, "https://o.jp/d.pdf", "資料"), (1, 5, "https://o.jp/e.pdf", "資料"), (1, 6, "https://o.jp/f.pdf", "x")], "doc_id long, pos int, url string, text string")
    texts = spark.createDataFrame([("https://o.jp/b.pdf", "spec " * 30, None), ("https://o.jp/c.pdf", "spec  " * 30, None), ("https://o.jp/d.pdf", None, "password_protected"), ("https://o.jp/e.pdf", "other " * 30, None), ("https://o.jp/f.pdf", None, "parse_failed")], "url string, body string, error string")
    limits = config.Limits(html=1000, pdf_total=200, per_pdf=120, max_pdfs=3)
    accepted = analyze.attachments(links, texts, limits)
    assert [(r.bare[-5:], r["class"], r.budget) for r in accepted.orderBy("rank").collect()] == [("b.pdf", "high", 100), ("e.pdf", "other", 100)]
    row = analyze.analyzed(analyze.prepared(docs, accepted, limits)).first()
    assert (row.matched, row.quotes, row.company_relevance, len(row.pdfs)) == (1, 1, "A", 2)
    with pytest.raises(ValueError):
        analysis.Analyzers().get("mock", write=True)


def test_pages_of_a_long_pdf(spark):
    # by paragraphs the second page's heading would come along without its text
    pages = ["表紙\n\n" + "あ" * 300, "1. 業務内容\n\n" + "い" * 300, "2. 提出方法\n\n" + "う" * 300]
    body = "\n\n".join(pages)
    docs = spark.createDataFrame([(1, "https://o.jp/1", "page")], "doc_id long, url string, text string")
    links = spark.createDataFrame([(1, 0, "https://o.jp/a.pdf", "仕様書")], "doc_id long, pos int, url string, text string")
    limits = config.Limits(html=1000, pdf_total=400, per_pdf=400, max_pdfs=1)

    def sent(page_texts):
        texts = spark.createDataFrame([("https://o.jp/a.pdf", body, None, page_texts)], "url string, body string, error string, page_texts array<string>")
        return analyze.prepared(docs, analyze.attachments(links, texts, limits), limits).first().pdfs[0]

    for known in (pages, None):
        want = analysis.choose_text(body, known, 400)
        assert (sent(known).text, sent(known).strategy) == want[:2]
    assert analysis.choose_text(body, pages, 400) != analysis.choose_text(body, None, 400) and sent(pages).text == pages[0]


def test_source_check_warnings(spark):
    orgs, sources = registry.load(spark, CHECKED)
    item = lambda k, dated: f"<item><title>T{k}</title><link>https://o.jp/{k}</link>{'<pubDate>Wed, 05 Aug 2026 00:00:00 GMT</pubDate>' if dated else ''}<category>防災</category></item>"
    feed = lambda n, dated, more="": "<rss><channel>" + "".join(item(k, k < dated) for k in range(n)) + more + "</channel></rss>"
    mail = LIST.replace("</ul>", '<li><a href="mailto:a@o.jp">Mail</a></li><li><a href="">No link</a></li></ul>')

    def got(xml, page):
        fetched = spark.createDataFrame([("feed", "https://o.jp/f", xml), ("list", "https://o.jp/l", page)], "source_id string, base_url string, body string")
        return {r.source_id: r for r in check.check(sources, orgs, fetched).collect()}

    r = got(feed(5, 2), mail)
    assert (r["feed"].status, r["feed"].warnings, r["feed"].missing_date) == ("warning", ["dates"], 3)
    x = r["list"]
    assert (x.status, x.warnings, x.missing_title, x.missing_url, x.external, x.self_links, x.repeats) == ("warning", ["missing", "external", "self_links", "repeats"], 1, 1, 2, 1, 1)
    r = got(feed(4, 2), '<div id="m"><a href="/a">One</a></div>')  # half of the dates is not more than half
    assert [(r[k].status, r[k].warnings) for k in ("feed", "list", "fix", "hand")] == [("ok", []), ("ok", []), ("ok", []), ("unsupported", [])]
    r = got(feed(4, 4, "<item><title>E</title><link>https://else.com/</link></item>" + item(0, True)), LIST)
    assert (r["feed"].status, r["feed"].warnings) == ("warning", ["external", "repeats"])


def test_collection(spark):
    sources = spark.createDataFrame([("a", None), ("b", "2026-08-01"), ("c", None)], "source_id string, initial_since string")
    state = spark.createDataFrame([("c", dt.datetime(2026, 8, 5)), ("b", dt.datetime(2026, 8, 2))], "source_id string, last_successful_check_at timestamp")
    got = {r.source_id: str(r.since) for r in collection.periods(sources, state).collect()}
    assert got == {"a": "2026-07-01", "b": "2026-08-01", "c": "2026-08-02"}
    day = lambda n: dt.date(2026, 8, n)
    rows = [("a", 0, "u0", day(1), True), ("a", 1, "u0", day(1), True), ("a", 2, "u2", None, True), ("a", 3, "u3", day(9), False), ("b", 0, "x", day(2), True), ("b", 1, "y", day(3), True)]
    df = spark.createDataFrame(rows, "source_id string, pos int, url string, published date, is_new boolean").withColumns({"since": F.lit(day(1)), "run_date": F.lit(day(7)), "limit_hit": F.lit(False)})
    out = {r.source_id: (r.in_period, r.new, r.processed, r.remaining, r.advanced) for r in collection.funnel(collection.process(df, 2), F.lit(False)).collect()}
    assert out == {"a": (3, 2, 2, 0, True), "b": (2, 2, 2, 0, True)}
    out = {r.source_id: (r.processed, r.remaining, r.advanced) for r in collection.funnel(collection.process(df, 1), F.lit(False)).collect()}
    assert out == {"a": (1, 1, False), "b": (1, 1, False)}


def test_batch(spark):
    day = dt.date(2026, 8, 5)
    # source b hits the limit at its second new row; a and last come behind it in the list
    sources = spark.createDataFrame([("z", 0, None), ("f", 1, "no feed"), ("none", 2, None), ("old", 3, None), ("b", 4, None), ("a", 5, None), ("last", 6, None)], "source_id string, place int, failure string")
    rows = [("z", 0, True, False, False), ("z", 1, False, False, False), ("z", 2, False, False, True), ("f", 0, True, True, False), ("b", 0, True, False, False), ("b", 1, True, True, False), ("b", 2, True, False, False), ("b", 3, True, False, False), ("a", 0, True, True, False)]
    df = spark.createDataFrame(rows, "source_id string, pos int, is_new boolean, limit_hit boolean, bad boolean").selectExpr("*", "concat(source_id, pos) AS url", "DATE'2026-08-05' AS published")
    df = df.union(spark.createDataFrame([("old", 0, True, False, False, "o", dt.date(2026, 7, 1))], df.schema)).withColumns({"since": F.lit(day), "run_date": F.lit(day)})
    out = collection.batch(sources, df, 3, F.col("bad"))
    got = {r.source_id: (r.in_period, r.new, r.processed, r.created, r.duplicates, r.failed, r.remaining, r.state) for r in out.collect()}
    assert got == {
        "z": (3, 1, 1, 1, 1, 1, 0, "Not advanced"), "f": (0, 0, 0, 0, 0, 0, 0, "Failed"), "none": (0, 0, 0, 0, 0, 0, 0, "Advanced"), "old": (0, 0, 0, 0, 0, 0, 0, "Advanced"), "b": (4, 2, 2, 1, 0, 1, 0, "Not advanced"),
    }
    assert {r.source_id: r.reason for r in out.collect() if r.reason} == {"z": "One or more candidates failed.", "f": "no feed", "b": "Claude CLI usage limit reached."}
    assert collection.batch_totals(sources, out).first().asDict() == {"selected": 7, "run": 5, "stopped": True, "created": 2, "previewed": 0, "duplicates": 1, "failed": 2, "remaining": 0}
    placed = collection.process(df.join(sources.select("source_id", "place"), "source_id").filter("source_id <> 'f'"), 3, "place")
    assert {(r.source_id, r.pos) for r in placed.filter("started").collect()} == {("z", 0), ("z", 1), ("z", 2), ("b", 0), ("b", 1)}
    # nobody hits a limit: all run, a preview advances nothing
    calm = collection.batch(sources, df.withColumn("limit_hit", F.lit(False)), 3, F.col("bad"), write=False)
    assert calm.count() == 7 and calm.filter("advanced").count() == 0 and {r.source_id: r.remaining for r in calm.collect()}["b"] == 1
    assert collection.batch_totals(sources, calm).first().asDict() == {"selected": 7, "run": 7, "stopped": False, "created": 0, "previewed": 5, "duplicates": 1, "failed": 1, "remaining": 1}


def test_sink(spark, tmp_path):
    made = analysis.mock_analysis(spark.createDataFrame([("https://o.jp/1", "A line that is long enough", "T", "O", "S"), ("https://o.jp/1", "A line that is long enough", "T", "O", "S")], "url string, text string, title string, organization string, source string"))
    rows, path = sink.sink_rows(made), str(tmp_path / "sink")
    assert rows.columns == [c for c in sink.COLUMNS if c != "登録日時"] and rows.first()["文書種別"] == "RFI" and rows.first()["根拠引用"] == ["・A line that is long enough"]
    with pytest.raises(ValueError):
        sink.append(rows, path, spark.createDataFrame([("x",)], "option string"))
    assert [sink.append(rows, path), sink.append(rows, path)] == [1, 0]
    kinds = spark.createDataFrame([(n, k if n != "分野" else "select") for n, k in sink.COLUMNS.items() if n != "確認状態"], "name string, kind string")
    assert {(r.name, r.actual) for r in sink.mismatches(kinds).collect()} == {("分野", "select"), ("確認状態", None)}
    with pytest.raises(Exception):
        spark.range(1).select(sink.label(F.lit("zz"), {"a": "b"})).collect()


def test_stages_ids_and_limits(spark):
    assert sink.usage_limit('{"a": ["x", "You’ve hit your limit · resets 3pm"]}', "") == "You’ve hit your limit · resets 3pm"
    assert sink.usage_limit("no", "rate limit") is None and sink.usage_limit("", " You've hit your limit ") == "You've hit your limit"
    url = "https://host/a0a0a0a0a0a0a0a0a0a0a0a0a0a0a0a0/Name-0123456789ABCDEF0123456789abcdef?v=1"
    assert spark.range(1).select(sink.table_id(F.lit(url))).first()[0] == "01234567-89ab-cdef-0123-456789abcdef"
    df = spark.createDataFrame([("fetch", ""), ("content", ""), ("analyzer", "schema"), ("analyzer", "x")], "e string, m string")
    assert [r[0] for r in df.select(sink.analysis_stage(F.col("e"), F.col("m"))).collect()] == ["html_fetch", "content_extract", "ai_validation", "ai_analysis"]


def test_pdf_files(spark):
    def parser(raw):
        if b"lock" in raw:
            raise pdf.PdfError("password_protected")
        return [p.decode() for p in raw.split(b"\n", 1)[1].split(b"|")]

    files = spark.createDataFrame([(1, b"%PDF-\nA  b|"), (2, b"x"), (3, b"%PDF-lock"), (4, b"%PDF-\n |"), (5, None), (6, b"%PDF-\n" + b"|" * 600), (7, b"%PDF-")], "k int, content binary")
    got = {r.k: (r.error_code, r.text, r.warnings) for r in pdf.extracted(files, parser).collect()}
    assert got[1] == (None, "A b", ["empty_pages"]) and [got[k][0] for k in (2, 3, 4, 5, 6, 7)] == ["invalid_pdf", "password_protected", "no_text", "invalid_pdf", "too_many_pages", "parse_failed"]


def test_settings():
    good = "version: 1\nname: n\n" + "".join(f"{k}: [a]\n" for k in config.LISTS)
    assert config.criteria(good)["direct_fit"] == ["a"] and "- その他" in config.prompt("x {{CATEGORY_OPTIONS}}")
    for bad in (good + "more: 1\n", good.replace("direct_fit: [a]", "direct_fit: []")):
        with pytest.raises(ValueError):
            config.criteria(bad)
    with pytest.raises(ValueError):
        config.prompt("x")
    assert config.Limits.of({"AI_INPUT_MAX_PDFS": "2"}).max_pdfs == 2
    with pytest.raises(ValueError):
        config.bounded_int("0", 1, 1, 5)


def test_site_and_commands(spark, tmp_path, capsys):
    path = tmp_path / "r.yaml"
    path.write_text(CHECKED, encoding="utf-8")
    assert cli.main(["sources:validate", "--registry", str(path)], spark) == 0 and cli.main(["sources:list", "--registry", str(path), "--enabled"], spark) == 0
    assert "feed" in capsys.readouterr().out and cli.main(["nothing"], spark) == 2 and cli.main(["sources:check", "--registry", str(path), "--all", "--enabled"], spark) == 2
    assert cli.main(["site:build", "--registry", str(path), "--output", str(tmp_path / "site")], spark) == 0
    page = (tmp_path / "site" / "index.html").read_text(encoding="utf-8")
    assert page.count("<section") == 8 and page.index("Feed") < page.index("Hand")
    path.write_text(REGISTRY, encoding="utf-8")
    assert cli.main(["sources:validate", "--registry", str(path)], spark) == 1


def test_search(spark):
    df = spark.createDataFrame([("tokyo bid page",), ("osaka bid",)], "t string")
    found = lambda q: df.filter(catalog.matches_all(F.col("t"), q)).count()
    assert (found(""), found("BID"), found("bid tokyo"), found("none")) == (2, 2, 1, 0)
    assert site.LAYERS["prefecture"] == "都道府県"


def test_source_check_settings(spark):
    def got(extra, page, kind="list_page", header=None):
        text = CHECKED.replace("url: \"https://o.jp/l\", collector_type: list_page", f'url: "https://o.jp/l", collector_type: {kind}').replace('link_selector: "#m a", title_excludes: [終了]', extra)
        orgs, sources = registry.load(spark, text)
        fetched = spark.createDataFrame([("list", "https://o.jp/l", page, header)], "source_id string, base_url string, body string, content_type string")
        return check.check(sources.filter("id = 'list'"), orgs, fetched if header else fetched.drop("content_type")).first()

    page = '<div id="m"><a href="/a">RFI notice</a><a href="/b">ＦＡＱ　一覧</a><a href="/c">Other F A Q</a></div>'
    r = got('link_selector: "#m a", title_includes: [RFI]', page)
    assert (r.status, r.usable) == ("ok", 1) and [x.title for x in r.samples] == ["RFI notice"]
    for pattern in ("FAQ", "ＦＡＱ", "f aq"):
        assert got(f'link_selector: "#m a", title_excludes: ["{pattern}"]', page).usable == 1
    r = got('link_selector: "a:hover", allow_empty_candidates: true', page)
    assert r.status == "error" and r.error.startswith("selector not understood")
    assert got("title_excludes: [x]", page).error == check.NO_SELECTOR
    r = got('link_selector: ".none", allow_empty_candidates: true', page)
    assert (r.status, r.warnings, r.error) == ("warning", ["empty"], None) and got('link_selector: ".none"', page).error == "no match"
    assert got('link_selector: "#m a"', page, header="application/pdf").warnings == ["content type"] and got('link_selector: "#m a"', page, header="text/html").status == "ok"
    feed = "<rss><channel><item><title>T</title><link>https://o.jp/1</link><category>防災 情報</category></item></channel></rss>"
    assert got("category_includes: [防災情報]", feed, "rss").usable == 1 and got("category_includes: [ＲＦＩ]", feed, "rss").usable == 0
    assert got("title_excludes: [x]", "<rss>", "rss").error.startswith("not well formed")
    orgs, sources = registry.load(spark, CHECKED)
    lost = check.check(sources.withColumn("organization_id", F.lit("nobody")), orgs, spark.createDataFrame([("feed", "https://o.jp/f", FEED)], "source_id string, base_url string, body string"))
    assert {(r.source_id, r.error) for r in lost.filter("status = 'error'").collect()} == {(s, "unknown organization") for s in ("feed", "list", "fix", "bare")}


def test_collection_from_registry_to_state(spark, tmp_path):
    from fieldsieve.sources import files

    orgs, sources = registry.load(spark, CHECKED)
    fetched = spark.createDataFrame([("feed", "https://o.jp/f", FEED), ("list", "https://o.jp/l", LIST), ("bare", "https://o.jp/b", LIST)], "source_id string, base_url string, body string")
    chosen = registry.selected(spark, orgs, sources, ids=["feed", "list", "fix", "bare"])
    path, at = str(tmp_path / "state"), F.expr("TIMESTAMP'2026-08-07 03:00:00'")
    known = spark.createDataFrame([("https://o.jp/0",)], "official_url string")
    named, candidates = collection.collected(chosen, orgs, fetched, files.read_state(spark, path), known, at)
    said = spark.createDataFrame([("list", "https://o.jp/a", False, False)], "source_id string, url string, ok boolean, limit_hit boolean")
    got = {r.source_id: (r.collected, r.unique, r.in_period, r.new, r.created, r.duplicates, r.failed, r.state) for r in collection.run(named, candidates, said, 5).collect()}
    assert got == {"feed": (2, 2, 2, 1, 1, 1, 0, "Advanced"), "list": (1, 1, 1, 1, 0, 0, 1, "Not advanced"), "fix": (1, 1, 1, 1, 1, 0, 0, "Advanced"), "bare": (0, 0, 0, 0, 0, 0, 0, "Failed")}
    out, code = collection.commit(spark, path, collection.run(named, candidates, said, 5), at)
    assert code == 1 and {r.source_id for r in files.read_state(spark, path).collect()} == {"feed", "fix"}
    later = {r.source_id: str(r.since) for r in collection.collected(chosen, orgs, fetched, files.read_state(spark, path), known, at)[0].collect()}
    assert later == {"feed": "2026-08-04", "fix": "2026-08-04", "list": "2026-07-01", "bare": "2026-07-01"}
    # a state that can't be written
    (tmp_path / "file").write_text("x")
    out, code = collection.commit(spark, str(tmp_path / "file" / "state"), collection.run(named, candidates, said.limit(0), 5).filter("source_id = 'fix'"), at)
    assert code == 1 and tuple(out.select("state", "reason", "advanced").first()) == ("Not advanced", collection.WRITE_FAILED, False)


def test_lists_of_urls_and_snapshots(spark):
    from fieldsieve.plans import register

    entries = spark.createDataFrame([(1, "a", False), (2, "b", False), (3, "a", True), (5, "c", False), (6, "d", False)], "line int, url string, input_duplicate boolean")
    outcomes = spark.createDataFrame([("a", "created"), ("b", "duplicate"), ("c", "created"), ("d", "created")], "url string, status string")
    rows = register.listed(entries, outcomes, F.col("url") == "c")
    assert [(r.line, r.status) for r in rows.orderBy("line").collect()] == [(1, "created"), (2, "duplicate"), (3, "input_duplicate"), (5, "failed")]
    assert register.list_summary(rows.withColumn("all", F.lit(1)), ["all"]).drop("all").first().asDict() == {"previewed": 0, "created": 1, "duplicate": 1, "input_duplicate": 1, "failed": 1}
    docs = spark.createDataFrame([("u", 10, ["https://a/x.pdf#1", "https://a/x.pdf", "https://a/y.pdf"]), ("v", 5, [])], "url string, body_length int, pdf_urls array<string>")
    pdfs = spark.createDataFrame([("u", 100), ("u", 50)], "url string, characters long")
    assert {tuple(r) for r in register.content_snapshot(docs, pdfs, "url").collect()} == {("u", 10, 2, 2, 150), ("v", 5, 0, 0, 0)}
    pages = spark.createDataFrame([("https://a/1",), ("http://a/2",), ("https://a/3",)], "url string")
    said = spark.createDataFrame([("https://a/1", "https://a/1", ["行政DX"], None, None)], "url string, final_url string, categories array<string>, error_class string, message string")
    known = spark.createDataFrame([("https://a/2",)], "official_url string")
    options = spark.createDataFrame([("行政DX",)], "option string")
    status = lambda write, provider: {r.url[-1]: (r.status, r.phase, r.stage) for r in register.registered(pages, said, known, options, write, provider).collect()}
    assert status(False, "mock") == {"1": ("previewed", None, None), "2": ("duplicate", "preflight", None), "3": ("failed", None, "ai_analysis")}
    assert status(True, "mock")["1"] == ("failed", None, "ai_analysis") and status(True, "other")["1"] == ("created", None, None)
    with pytest.raises(ValueError):
        register.verified(pages, pages, pages, 6)


def test_catalogue_problems_and_search(spark):
    orgs, sources = registry.load(spark, CHECKED.replace("organizations:", "organizations:\n  - {id: x, name: X, organization_type: public_agency, official_domain: x.jp, enabled: true, prefecture: 東京都}\n  - {id: y, name: Y, organization_type: prefecture, official_domain: y.jp, enabled: true}\n  - {id: z, name: Z, organization_type: prefecture, official_domain: z.jp, enabled: true, prefecture: 江戸}"))
    from fieldsieve.operators import hierarchy, sink

    roots = hierarchy.roots(hierarchy.closure(orgs, "id", "parent_organization_id"))
    dim = catalog.prefectures(spark)
    assert {tuple(r) for r in catalog.problems(orgs, roots, dim).collect()} == {("x", "type"), ("y", "no prefecture"), ("z", "unknown prefecture")}
    shown = catalog.public_sources(orgs, sources, roots, dim)
    assert [tuple(r) for r in catalog.search_view(shown, "ｏ.jp  FEED").collect()] == [("kanto", "prefecture", "O", 1, 1)] and catalog.search_view(shown, "nothing").count() == 0
    with pytest.raises(ValueError):
        sink.only_table(["a", "b"])
