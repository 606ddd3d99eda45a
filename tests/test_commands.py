import json
import sys

import pytest
from pyspark.sql import functions as F

from fieldsieve import cli
from fieldsieve.functions import urls
from fieldsieve.operators import analysis, sink
from fieldsieve.plans import external, pages
from fieldsieve.sources import pdf, registry

REGISTRY = """
version: 1
organizations:
  - {id: top, name: Top, organization_type: prefecture, official_domain: top.jp, enabled: true, prefecture: 東京都}
  - {id: sub, name: Sub, organization_type: designated_city, official_domain: sub.jp, enabled: false, prefecture: 東京都, parent_organization_id: top}
sources:
  - {id: list, organization_id: top, name: List, url: "https://top.jp/l", collector_type: list_page, source_category: rfi, priority: high, enabled: true, link_selector: "#m a", content_selector: "#c"}
  - {id: other, organization_id: sub, name: Other, url: "https://sub.jp/l", collector_type: manual, source_category: rfi, priority: low, enabled: true}
"""
LIST = '<div id="m"><li>2026年8月5日<a href="/a">One</a></li><li><a href="/b">Two</a></li></div>'
PAGE = '<title>T</title><h1>Need</h1><div id="c"><p>' + "This line says what is needed here.\n" * 10 + '<a href="/x.pdf">仕様書</a></div><time datetime="2026-08-05"></time>'


def parser(raw):
    if b"lock" in raw:
        raise pdf.PdfError("password_protected")
    return [raw.split(b"\n", 1)[1].decode()]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    (d / "r.yaml").write_text(REGISTRY, encoding="utf-8")
    spark.createDataFrame([("list", "https://top.jp/l", LIST, "text/html")], "source_id string, base_url string, body string, content_type string").write.parquet(str(d / "fetched"))
    rows = [("list", "https://top.jp/a", PAGE, "text/html; charset=utf-8"), ("list", "https://top.jp/b", PAGE, "application/pdf"), ("other", "https://top.jp/o", PAGE, "text/html")]
    spark.createDataFrame(rows, "source_id string, url string, html string, content_type string").write.parquet(str(d / "pages"))
    rows = [("list", "https://top.jp/x.pdf", 200, "application/pdf", b"%PDF-\n" + b"spec of the work " * 20), ("list", "https://top.jp/y.pdf", 200, "text/html", b"%PDF-\nz"), ("list", "https://else.com/z.pdf", 200, "application/pdf", b"%PDF-\nz")]
    spark.createDataFrame(rows, "source_id string, url string, http_status int, content_type string, content binary").write.parquet(str(d / "pdfs"))
    return d


def run(spark, files, command, *args):
    given = {"fetched", "pages", "pdfs"} & {a[2:] for a in args if a in ("--fetched", "--pages", "--pdfs")}
    argv = [command, "--registry", str(files / "r.yaml")]
    for a in args:
        argv.append(a)
        if a[2:] in given:
            argv.append(str(files / a[2:]))
    return cli.main(argv, spark, parser)


def test_bad_use(spark, files, capsys):
    for args in (["nothing"], ["sources:check", "--source", "list"], ["sources:check", "--source", "zz", "--fetched"], ["sources:check", "--all", "--fetched", "--limit", "21"], ["content:check"], ["collect:batch", "--state", "s"]):
        assert run(spark, files, *args) == 2, args
    assert cli.main(["sources:validate", "--registry", "/nowhere.yaml"], spark) == 1


def test_checks_of_pages_and_attachments(spark, files, capsys, tmp_path):
    assert run(spark, files, "sources:check", "--source", "list", "--fetched", "--json") == 0
    capsys.readouterr()
    report = tmp_path / "out" / "c.json"
    assert run(spark, files, "content:check", "--source", "list", "--pages", "--json", "--output", str(report)) == 1  # one page isn't HTML
    shown = json.loads(capsys.readouterr().out)
    assert shown == json.loads(report.read_text())
    good, bad = sorted(shown, key=lambda r: r["url"])
    assert good["title"] == "Need" and good["content_selector_used"] == "#c" and good["published_at"] == "2026-08-05" and "body_text" not in good and good["warnings"] == [] and bad["error"] == "content type"
    assert run(spark, files, "pdf:check", "--source", "list", "--pdfs", "--json") == 1
    assert {r["url"][-5:]: r["error_code"] for r in json.loads(capsys.readouterr().out)} == {"x.pdf": None, "y.pdf": "content_type", "z.pdf": "domain"}
    assert run(spark, files, "ai:check", "--source", "list", "--pages", "--pdfs", "--json") == 0 and '"matched": 1' in capsys.readouterr().out
    assert run(spark, files, "source:verify", "--source", "list", "--fetched", "--pages") == 1 and "content" in capsys.readouterr().out


def test_sink_and_collection_commands(spark, files, capsys, tmp_path):
    made = analysis.mock_analysis(spark.createDataFrame([("https://top.jp/b", "A line that is long enough", "T", "O", "S")], "url string, text string, title string, organization string, source string"))
    sink.append(sink.sink_rows(made), str(tmp_path / "sink"))
    sink.stored(spark, str(tmp_path / "sink")).drop("分野").write.parquet(str(tmp_path / "less"))
    assert run(spark, files, "sink:check", "--sink", str(tmp_path / "sink")) == 0 and run(spark, files, "sink:check", "--sink", str(tmp_path / "less")) == 1
    assert run(spark, files, "sink:register", "--source", "list", "--pages", "--url", "https://top.jp/a", "--write") == 1  # the mock is never written
    (tmp_path / "urls.txt").write_text("# list\nhttps://top.jp/a\nhttps://top.jp/a\nhttps://top.jp/b\n")
    capsys.readouterr()
    assert run(spark, files, "sink:batch", "--source", "list", "--pages", "--file", str(tmp_path / "urls.txt"), "--sink", str(tmp_path / "sink")) == 0
    shown = capsys.readouterr().out
    assert "input_duplicate" in shown and "preflight" in shown and "previewed" in shown
    collect = lambda command, *more: run(spark, files, command, "--fetched", "--state", str(tmp_path / "state"), "--run-at", "2026-08-07 03:00:00", *more)
    assert collect("collect:batch", "--all") == 0 and collect("collect:batch", "--sources", "list,list") == 1 and collect("collect:run", "--source", "list", "--since", "x") == 2
    assert collect("collect:run", "--source", "list", "--write") == 1 and "Not advanced" in capsys.readouterr().out
    assert run(spark, files, "site:build", "--output", str(tmp_path / "site")) == 0
    page = (tmp_path / "site" / "index.html").read_text(encoding="utf-8")
    assert "List" in page and 'data-text="top list https://top.jp/l"' in page and "1 organizations" in page and (tmp_path / "site" / "search.js").exists()


def test_what_is_not_read(spark):
    orgs, sources = registry.load(spark, REGISTRY)
    got = {r.organization_id: set(r.domains) for r in pages.trusted_domains(orgs).collect()}
    assert got == {"top": {"top.jp"}, "sub": {"sub.jp", "top.jp"}}
    rows = spark.createDataFrame([("list", "https://a.top.jp/"), ("list", "https://sub.jp/"), ("other", "https://top.jp/"), ("zz", "https://top.jp/"), ("list", "https://u:p@top.jp/"), ("list", "https://10.0.0.1/"), ("list", "https://[::1]/"), ("list", "ftp://top.jp/")], "source_id string, url string")
    out = {(r.source_id, r.url): (r.refused, r.notes) for r in pages.with_source(rows, sources, orgs).collect()}
    assert out == {
        ("list", "https://a.top.jp/"): (None, []), ("list", "https://sub.jp/"): ("domain", []), ("other", "https://top.jp/"): (None, ["disabled organization"]), ("zz", "https://top.jp/"): ("unknown source", []),
        ("list", "https://u:p@top.jp/"): ("credentials", []), ("list", "https://10.0.0.1/"): ("address", []), ("list", "https://[::1]/"): ("address", []), ("list", "ftp://top.jp/"): ("scheme", []),
    }
    links = spark.createDataFrame([(1, 0, "https://a/x.pdf#1"), (1, 1, "https://a/y.pdf")], "doc_id long, pos int, url string")
    assert [r.pos for r in pages.skipped(links, spark.createDataFrame([(1, "https://a/x.pdf")], "doc_id long, bare string")).collect()] == [1]
    assert spark.range(1).select(urls.unsafe(F.lit(None).cast("string"), F.array(F.lit("a")))).first()[0] == "scheme"


def output(**more):
    good = {"is_target": True, "document_type": "rfi", "problem_summary": "p", "desired_state": "d", "request_to_private_sector": "r", "categories": ["行政DX"], "company_relevance": "A", "contact_recommendation": "high", "reason": "r", "evidence_quotes": [{"source_type": "html", "source_url": "https://a.jp/", "quote": "q"}]}
    return json.dumps({"type": "result", "subtype": "success", "is_error": False, "result": json.dumps(good | more, ensure_ascii=False), "usage": {"input_tokens": 7}})


def test_reading_of_outputs(spark):
    raw = [output(), output(extra=1), output(reason=" "), output(categories=["x"]), output(contact_recommendation="none", company_relevance="Z"), "no", output().replace("success", "other")]
    df = spark.createDataFrame(list(enumerate(raw)), "k int, raw string")
    got = {r.k: (r.stage, r.issues, r.analysis is None) for r in analysis.read_output(df, "raw").collect()}
    assert got[0] == (0, [], False) and got[1] == (8, ["keys"], True) and got[2][0] == 8 and "reason" in got[2][1] and got[3] == (8, ["unknown_category"], True) and "company_relevance" in got[4][1] and got[5][0] == 1 and got[6][0] == 3
    schema = analysis.json_schema()
    assert schema["required"] == analysis.ANALYSIS.names and schema["properties"]["categories"]["maxItems"] == 3 and schema["properties"]["evidence_quotes"]["items"]["properties"]["source_type"]["enum"] == ["html", "pdf"]


def test_an_analyzer_that_is_a_program(spark, tmp_path):
    script = tmp_path / "tool.py"
    script.write_text(f"""
import pathlib, sys, time
text = sys.stdin.read()
good = {output()!r}
tries = pathlib.Path({str(tmp_path)!r}) / ("seen" + str(len(text)))
if "sleep" in text: time.sleep(30)
if "limit" in text: print("You've hit your limit - resets 3pm"); sys.exit(1)
if "fail" in text: sys.exit(3)
if "retry" in text and not tries.exists():
    tries.write_text("x"); print(good.replace('\\\\"is_target', 'oops')); sys.exit()
print(good)
""")
    rows = [(k, "T", "https://a.jp/", x) for k, x in enumerate(["fine", "sleep", "limit", "fail", "retry"])]
    df = spark.createDataFrame(rows, "doc_id int, title string, url string, text string").withColumn("pdfs", F.expr("CAST(NULL AS array<struct<rank:int,url:string,text:string,strategy:string>>)"))
    analyzers = analysis.Analyzers()
    analyzers.register("program", external.program([sys.executable, str(script)], "Head.", {"direct_fit": ["a"]}, timeout=5))
    got = {r.doc_id: (r.error, r.tries, r.stage, r.document_type) for r in analyzers.get("program", write=True)(df).collect()}
    assert got == {0: (None, 1, 0, "rfi"), 1: ("timeout", 1, 0, None), 2: ("usage limit: You've hit your limit - resets 3pm", 1, 0, None), 3: ("exit code 3", 1, 0, None), 4: (None, 2, 0, "rfi")}
    text = df.select(external.prompt("Head.", {"direct_fit": ["a"]}).alias("p")).first().p
    assert text.startswith("Head.\n\ndirect_fit:\n- a") and text.index(external.UNTRUSTED) < text.index("<document")
