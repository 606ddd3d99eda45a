import pytest

from fieldsieve.plans import catalog
from fieldsieve.sources import feeds, files, html, registry
from fieldsieve.streaming import state

PAGE = """<html><head><title>T</title></head><body><nav><a href="/n">no</a></nav>
<main id="main"><ul><li>2026年8月5日 <a href="a.html">One &amp; two</a><li><a href='https://x.org/b#f' class="k l">B</a></ul><p>first<p>second</main></body></html>"""
REGISTRY = """
version: 1
organizations:
  - {id: pref-a, name: A, organization_type: prefecture, official_domain: a.jp, enabled: true, prefecture: 東京都}
  - {id: city-b, name: B, organization_type: designated_city, official_domain: b.jp, enabled: true, prefecture: 東京都, parent_organization_id: pref-a}
  - {id: off, name: O, organization_type: prefecture, official_domain: o.jp, enabled: false, prefecture: 北海道, parent_organization_id: none}
sources:
  - {id: s1, organization_id: city-b, name: S1, url: "https://b.jp/x", collector_type: rss, source_category: rfi, priority: high, enabled: true}
  - {id: s2, organization_id: "off", name: S2, url: "https://o.jp/x", collector_type: list_page, source_category: rfi, priority: low, enabled: true, initial_since: "2026-02-30"}
  - {id: s3, organization_id: pref-a, name: S3, url: "https://b.jp/x#y", collector_type: list_page, source_category: plan, priority: low, enabled: false}
"""


def test_selectors():
    root = html.parse(PAGE)
    assert [n.attrs["href"] for n in html.select(root, "#main li > a")] == ["a.html", "https://x.org/b#f"]
    assert [n.attrs["href"] for n in html.select(root, "a.k.l, a[href^='/n']")] == ["/n", "https://x.org/b#f"]
    assert len(html.select(root, "main p")) == 2 and len(html.select(root, "li:not(:has(.k)) a")) == 1 and len(html.select(root, "li + li")) == 1
    found, error = html.links_of(PAGE, "#main a")
    assert error is None and found[0]["text"] == "One & two" and "2026年8月5日" in found[0]["context"]
    assert html.links_of(PAGE, "a:hover")[1].startswith("selector") and html.links_of(PAGE, ".none")[1] == "no match"


def test_feeds(spark):
    rdf = '<rdf:RDF><item rdf:about="x"><title> A  b </title><link>https://a/1</link><dc:date>2026-08-10T09:00:00+09:00</dc:date><dc:subject>防災, 安全、くらし</dc:subject></item></rdf:RDF>'
    rss = "<rss><channel><item><title>B</title><link>https://a/2</link><pubDate>Wed, 05 Aug 2026 00:00:00 GMT</pubDate><category>c1</category><category>c2</category></item></channel></rss>"
    df = spark.createDataFrame([(1, rdf), (2, rss), (3, "<!DOCTYPE x>" + rss), (4, "")], "f int, xml string")
    got = {r.f: (r.title, r.url, str(r.published_at), list(r.categories)) for r in feeds.items(df).collect()}
    assert got == {1: ("A b", "https://a/1", "2026-08-10", ["防災", "安全", "くらし"]), 2: ("B", "https://a/2", "2026-08-05", ["c1", "c2"])}


def test_registry(spark):
    orgs, sources = registry.load(spark, REGISTRY)
    assert {(r.coll, r.pos, r.field, r.issue) for r in registry.violations(orgs, sources).collect()} == {("sources", 1, "initial_since", "date"), ("sources", 2, "url", "repeats 0"), ("organizations", 2, "parent_organization_id", "unknown")}
    assert [r.id for r in registry.enabled_sources(orgs, sources).collect()] == ["s1"]
    assert [r.id for r in registry.by_municipality(orgs, sources, "A").collect()] == ["s1"]
    assert [r.id for r in registry.listed(orgs, sources, enabled=True).collect()] == ["s1", "s2"]
    assert [r.id for r in registry.unknown_ids(spark, ["s1", "zz"], sources).collect()] == ["zz"]
    with pytest.raises(ValueError):
        registry.load(spark, REGISTRY + "extra: 1")


def test_regions(spark):
    dim = catalog.prefectures(spark)
    assert dim.count() == 47 and dim.select("region_id").distinct().count() == 8


def test_url_files_and_state(spark, tmp_path):
    lists = spark.createDataFrame([("# x\nhttps://a/1\r\n\nhttps://a/1\nhttp://b",)], "value string")
    assert [(r.line, r.url, r.input_duplicate) for r in files.selected_urls(lists).orderBy("line").collect()] == [(2, "https://a/1", False), (4, "https://a/1", True), (5, "http://b", False)]
    with pytest.raises(ValueError):
        files.selected_urls(spark.createDataFrame([("ftp://x",)], "value string"))
    path = str(tmp_path / "state")
    assert files.read_state(spark, path).count() == 0
    for v in ("2026-08-01 00:00:00", "2026-08-05 00:00:00"):
        files.upsert_state(spark, path, spark.sql(f"SELECT 's' AS source_id, TIMESTAMP'{v}' AS last_successful_check_at"))
    assert str(files.read_state(spark, path).first()[1]) == "2026-08-05 00:00:00"


def test_streaming_marks(spark, tmp_path):
    spark.sql("SELECT id % 2 AS user_id, TIMESTAMP'2026-01-01' + make_interval(0,0,0,CAST(id AS INT)) AS ts FROM range(6)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in"))
    q = state.high_water_marks(stream).writeStream.format("memory").queryName("marks").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.user_id, r.last_ts.day, r.n_total) for r in spark.table("marks").collect()) == [(0, 5, 3), (1, 6, 3)]


def test_documents(spark):
    body = "本文です。" * 50
    page = f"""<html><head><title>T</title><base href="/files/"></head><body><h1> 案件 名 </h1><nav>menu</nav><div id="c"><p>{body}</p><p hidden>no</p><a href="a.PDF?x#page=2">A</a><a href="a.PDF?x#page=2">again</a><a href="b.html">B</a></div>
    <p>掲載日 2026年7月30日</p></body></html>"""
    dated = '<title>x</title><time datetime="none"></time><meta property="article:published_time" content="2026-08-05T10:00:00Z"><body>' + "y" * 250
    df = spark.createDataFrame([(1, "https://h/p/", page), (2, "https://h/", dated), (3, "https://h/", None), (4, "https://h/", "<h1>short</h1>")], "k int, url string, html string")
    got = {r.k: r for r in html.documents(df, url="url", selectors=["#none", "#c"]).collect()}
    assert (got[1].title, got[1].body_text, got[1].content_selector_used, got[1].used_fallback) == ("案件 名", body + "AagainB", "#c", False)
    assert [(x.url, x.text) for x in got[1].pdf_links] == [("https://h/files/a.PDF?x#page=2", "A")] and (str(got[1].published_at), got[1].published_at_source) == ("2026-07-30", "page_text")
    assert (str(got[2].published_at), got[2].published_at_source, got[2].used_fallback) == ("2026-08-05", "meta", True)
    assert got[3].error == "no title" and got[4].error == "no text" or got[4].title == "short"


def test_feeds_that_cannot_be_read(spark):
    item = "<item><title>A &amp; B</title><link>https://a/1</link><dc:title>other</dc:title><dc:date>2026-08-01</dc:date></item>"
    rows = {
        "comment": f"<rss><channel><!-- <item><title>no</title></item> -->{item}</channel></rss>", "cdata": "<rss><channel><item><title><![CDATA[<b> & c]]></title><link>https://a/2</link></item></channel></rss>", "open": "<rss><channel><item></channel></rss>",
        "none": "<rss><channel></channel></rss>", "page": "<html><body></body></html>", "doctype": "<!DOCTYPE rss><rss/>", "null": None, "declared": f'<?xml version="1.0" encoding="Shift_JIS"?><rss><channel>{item}</channel></rss>',
    }
    df = spark.createDataFrame(list(rows.items()), "f string, xml string").selectExpr("*", "1 AS i", "2 AS error", "3 AS feed_")
    got = {r.f: (r.pos, r.title, r.published_at, r.scan_error, r.i) for r in feeds.items(df, errors=True).collect()}
    assert got["comment"] == got["declared"] == (0, "A & B", None, None, 1) and got["cdata"][1] == "<b> & c"
    assert got["open"][3].startswith("not well formed") and [got[k][3] for k in ("none", "page", "doctype", "null")] == ["no items", "no channel", "document type", "empty"] and got["none"][0] is None
    assert {r.f for r in feeds.items(df).collect()} == {"comment", "cdata", "declared"}


def test_booleans_and_lists_of_a_registry(spark):
    orgs, sources = registry.load(spark, REGISTRY.replace("official_domain: a.jp, enabled: true", "official_domain: a.jp, enabled: True"))
    assert orgs.filter("id = 'pref-a'").first().enabled is True
    for bad in ("enabled: yes", "enabled: 1", "enabled: [true]", "enabled: true, title_excludes: x", "enabled: true, name: [a]", "enabled: true, title_excludes: [[a]]"):
        with pytest.raises(ValueError):
            registry.load(spark, REGISTRY.replace("priority: high, enabled: true", f"priority: high, {bad}"))
    _, sources = registry.load(spark, REGISTRY.replace("priority: high, enabled: true", 'priority: high, enabled: true, title_excludes: [a, " "], link_selector: "a\\0b"'))
    assert {(r.field, r.issue) for r in registry.violations(orgs, sources).filter("coll = 'sources' AND pos = 0").collect()} == {("title_excludes", "blank"), ("link_selector", "blank")}


def test_selections_of_a_registry(spark):
    orgs, sources = registry.load(spark, REGISTRY)
    assert [r.name for r in registry.organization_names(orgs).collect()] == ["A", "B", "O"] and registry.totals(orgs, sources).first().asDict() == {"organizations": 3, "sources": 3, "enabled_sources": 2}
    assert [(r.id, r.place) for r in registry.selected(spark, orgs, sources, ids=["s3", "s1"]).orderBy("place").collect()] == [("s3", 0), ("s1", 1)] and [r.id for r in registry.selected(spark, orgs, sources, all_=True).collect()] == ["s1"]
    for bad in ({}, {"all_": True, "ids": ["s1"]}, {"ids": ["s1", "s1"]}, {"ids": ["zz"]}, {"municipality": "nowhere"}):
        with pytest.raises(ValueError):
            registry.selected(spark, orgs, sources, **bad)


def test_a_swap_that_was_cut_short(spark, tmp_path):
    path = str(tmp_path / "state")
    row = lambda v: spark.sql(f"SELECT 's' AS source_id, TIMESTAMP'{v}' AS last_successful_check_at")
    files.upsert_state(spark, path, row("2026-08-01 00:00:00"))
    (tmp_path / "state").rename(tmp_path / "state.old")  # the old state has been moved, the new one hasn't come
    assert str(files.read_state(spark, path).first()[1]) == "2026-08-01 00:00:00"
    files.upsert_state(spark, path, row("2026-08-02 00:00:00"))
    assert str(files.read_state(spark, path).first()[1]) == "2026-08-02 00:00:00" and not (tmp_path / "state.old").exists()


def test_headers(spark):
    df = spark.createDataFrame([("rss", "text/xml"), ("rss", "text/html"), ("list_page", "Text/HTML; charset=x"), ("list_page", None), ("single_page", "application/pdf")], "kind string, content_type string")
    assert [r.w for r in df.withColumn("w", files.content_type_warning(df.kind, df.content_type)).collect()] == [None, "content type", None, "no content type", "content type"]
    got = spark.createDataFrame([(200, b"x", "application/pdf;a=b"), (200, b"x", "text/html"), (200, b"", None), (404, b"x", None)], "http_status int, content binary, content_type string")
    assert [r.error for r in files.fetch_errors(got, media=["application/pdf"]).collect()] == [None, "content_type", "empty", "http_status"]
