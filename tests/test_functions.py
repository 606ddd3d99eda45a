import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldsieve.functions import dates, text, urls


def values(spark, rows, col, kind="string"):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, x {kind}")
    return [r[1] for r in sorted(df.select("k", col(F.col("x"))).collect())]


def test_dates_in_several_notations(spark):
    rows = {
        "R8.8.5": dt.date(2026, 8, 5), "R8.9.4 PM3時": dt.date(2026, 9, 4), "R8.12.31": dt.date(2026, 12, 31), "R10.1.9": dt.date(2028, 1, 9), "2026年8月5日": dt.date(2026, 8, 5), "2026-08-05": dt.date(2026, 8, 5),
        "令和8年8月5日": dt.date(2026, 8, 5), "令和8年1月1日 2026/8/5": dt.date(2026, 8, 5), "R8": None, "AR8.1.2": None, "R2.0.1": None, "R8.13.1": None, "バージョンR1.2.3の資料": None, "2026-13-01 令和5年1月1日": None,
        "（２０２６年８月５日）": dt.date(2026, 8, 5), "Wed, 05 Aug 2026 09:00:00 +0900": dt.date(2026, 8, 5), "": None, None: None, "R1.2.3.4": None,
    }
    assert values(spark, list(rows), dates.date_candidate) == list(rows.values())


def test_strict_dates(spark):
    rows = ["2026/08/01", "2026-02-30", "20260801", "2026-13-01", "", "2026-08-01"]
    assert values(spark, rows, dates.strict_date) == [None] * 5 + [dt.date(2026, 8, 1)]


def test_white_space_and_matching(spark):
    assert values(spark, [" a　b \n c﻿d ", "", None], text.squeeze) == ["a b c d", "", None]
    assert values(spark, ["ＡＢ　c D", "ｶﾞ"], text.for_match) == ["abcd", "ガ"]
    assert values(spark, ["利用 者 は “AI” tool one", "a  b"], text.for_evidence)[1] == "a b"


@pytest.mark.parametrize("most", [1, 17, 40, 1000])
def test_head_and_tail_fit(spark, most):
    body = "".join(chr(97 + k % 26) for k in range(500))
    got = values(spark, [body, "", "short"], lambda c: text.head_tail(c, most))
    assert len(got[0]) == min(500, most) and got[1] == "" and got[2] == "short"[:most]


def test_chunks_put_together_again(spark):
    got = values(spark, ["x" * 4001, "", "ab"], text.chunks)
    assert [len(c) for c in got[0]] == [2000, 2000, 1] and got[1] == [] and got[2] == ["ab"]


def test_priority_order(spark):
    got = values(spark, ["仕様書と様式", "概要", "様式", "何か", "計画の地図"], lambda c: text.priority(c))
    assert got == ["high", "medium", "low", "other", "medium"]


def test_hosts(spark):
    got = values(spark, ["https://a.example.com/x", "http://EXAMPLE.com.:80/", "https://notexample.com", "x"], lambda c: urls.allowed(urls.host(c), F.array(F.lit("example.com"))))
    assert got == [True, True, False, False]
    assert values(spark, ["http://a/b", "https://a/b", "httpx"], urls.https_of) == ["https://a/b", None, None]
    assert values(spark, ["%E3%81%82+b", "%zz"], urls.decoded) == ["あ+b", "%zz"]


def test_resolving_and_addresses(spark):
    df = spark.createDataFrame([("https://h/a/b", "../c"), ("https://h/", "mailto:x"), ("https://h/", "//o/p"), (None, "x")], "b string, x string")
    assert [r[0] for r in df.select(urls.resolved("b", "x")).collect()] == ["https://h/c", None, "https://o/p", None]
    assert values(spark, ["::1", "2001:db8::5", "::ffff:8.8.8.8", "2600::1", "no"], urls.blocked_ipv6) == [True, True, True, False, None]


def test_long_runs_of_blanks(spark):
    n = 1 << 20
    long_ = ["a" + " " * n + "b", " " * n + "x" + "\u3000\n" * (n // 2), "\ufeff" * n, "a\x85b"]
    assert values(spark, long_, text.squeeze) == ["a b", "x", "", "a\x85b"]
    assert values(spark, long_, text.stripped)[1:] == ["x", "", "a\x85b"] and len(values(spark, long_, text.stripped)[0]) == n + 2
    assert values(spark, long_, text.for_match)[0] == "ab" and values(spark, long_, text.for_evidence)[0] == "a b" and values(spark, long_, text.page_text)[0] == "a b"
    assert len(values(spark, long_, text.fingerprint)[0]) == 64


def test_quotes_that_are_taken_for_straight_ones(spark):
    assert values(spark, ["“x”„‟〝〞〟", "‘’‚‛ʼ"], text.for_evidence) == ['"x"""' + '"' * 3, "'" * 4 + "ʼ"]


def test_platform_dates(spark):
    rows = {
        "August 5, 2026": dt.date(2026, 8, 5), "Wed Aug 05 2026 10:00:00": dt.date(2026, 8, 5), "5 August 1999": dt.date(1999, 8, 5), "12/31/1999": dt.date(1999, 12, 31), "1999-12-31": dt.date(1999, 12, 31), "1999-12-31T23:00:00-05:00": dt.date(2000, 1, 1),
        "1999-12-31T23:00:00+0900": dt.date(1999, 12, 31), "1999-12-31T23:00:00Z": dt.date(1999, 12, 31), "1999-12-31T01:00:00": dt.date(1999, 12, 31), "August 32, 2026": None, "13/31/1999": None, "about August": None,
    }
    assert values(spark, list(rows), dates.date_candidate) == list(rows.values())


def test_normal_urls(spark):
    rows = {
        "HTTP://Example.COM:80/a/../b/./c#x": "http://example.com/b/c", "https://例え.jp": "https://xn--r8jz45g.jp/", "https://a.jp:443/x y?q=あ": "https://a.jp/x%20y?q=%E3%81%82", "http://a.jp:8080": "http://a.jp:8080/", "https://a.jp/a/..": "https://a.jp/",
        "https://a.jp/%2e%2E/b": "https://a.jp/b", "https://[::1]:443/x": "https://[::1]/x", "mailto:a@b": None, "https://": None, "https://a b/": None, "https://a.jp:99999/": None, None: None, " https://a.jp/x\n": "https://a.jp/x",
    }
    assert values(spark, list(rows), urls.canonical) == list(rows.values())
    assert values(spark, ["例え.JP.", "a.jp", ""], urls.normal_domain) == ["xn--r8jz45g.jp", "a.jp", None]


def test_hosts_as_browsers_have_them(spark):
    """Cases of the URL standard."""
    rows = {
        "http://0x7f.1/": "http://127.0.0.1/", "http://2130706433/": "http://127.0.0.1/", "http://0300.168.0.0xF0": "http://192.168.0.240/", "http://1.2.3.4./": "http://1.2.3.4/", "http://0x": "http://0.0.0.0/", "http://192.0x00A80001": "http://192.168.0.1/",
        "http://faß.de/": "http://xn--fa-hia.de/", "http://FAẞ.de/": "http://xn--fa-hia.de/", "http://βόλος.com/": "http://xn--nxasmm1c.com/", "http://Ｇｏ.com": "http://go.com/", "http://ab­c.de/": "http://abc.de/", "http://日本語。jp/": "http://xn--wgv71a119e.jp/",
        "http://%30%78%63%30%2e%30%32%35%30.01": "http://192.168.0.1/", "http://[1:2::3]:80/": "http://[1:2::3]/", "http://[2001:DB8:0:0:1:0:0:1]/": "http://[2001:db8::1:0:0:1]/", "http://[::127.0.0.1]": "http://[::7f00:1]/", "http://[1:0::]": "http://[1::]/",
        "http://[0:1:0:1:0:1:0:1]": "http://[0:1:0:1:0:1:0:1]/", "http://xn--fa-hia.de/": "http://xn--fa-hia.de/", "http://host%41.com/": "http://hosta.com/", "http://a_b.com/": "http://a_b.com/", "http://user:p\"w@h.com/": "http://user:p%22w@h.com/", "http://foo.0x": None,
        "http://256.256.256.256/": None, "http://1.2.3.4.5/": None, "http://4294967296/": None, "http://1.2.3.08/": None, "http://a.b.c.d.2e/": "http://a.b.c.d.2e/", "http://xn--/": None, "http://xn--a/": None, "http://a%00b/": None, "http://[::1%25eth0]/": None, "http://[1::2::3]/": None,
        "http://́a.com/": None, "http://a b.com/": None, "http://foo.1": None, "http://a..b/": "http://a..b/", "http://example.com./x": "http://example.com./x", "https://a.example/x#y": "https://a.example/x", "http://1e5.example/": "http://1e5.example/",
    }
    got = dict(zip(rows, values(spark, list(rows), urls.canonical)))
    assert {k: (got[k], v) for k, v in rows.items() if got[k] != v} == {}
    assert values(spark, ["faß.de.", "[::1]", "0x7f.1", "::FFFF:1.2.3.4", "a b"], urls.normal_domain) == ["xn--fa-hia.de", "::1", "127.0.0.1", "::ffff:102:304", None]
    domains = F.array(F.lit("127.0.0.1"), F.lit("a.example"))
    normal = values(spark, ["http://0x7f.1/", "http://a.example/", "http://017700000001/", "http://2130706433/", "http://user@a.example/"], urls.canonical)
    assert values(spark, normal, lambda c: urls.unsafe(c, domains)) == ["address", None, "address", "address", "credentials"]
    long = "http://a.example/" + "x" * (3 << 20)
    assert values(spark, [long, "ftp://x"], urls.https_of) == ["https" + long[4:], None]


def test_labels_bytes_and_secrets(spark):
    from fieldsieve.operators import analysis
    from fieldsieve.sources import files

    df = spark.createDataFrame([(" 仕様書 ", "/a/b.pdf"), ("", "/a/%E3%81%82.pdf"), (None, "/" + "x" * 40)], "t string, p string")
    assert [r[0] for r in df.select(text.link_label(F.col("t"), F.col("p"))).collect()] == ["仕様書", "あ.pdf", "x" * 30 + "…"]
    raw = spark.createDataFrame([(b"a\xff",), ("é".encode(),), (None,)], "b binary")
    assert [tuple(r) for r in raw.select(text.lossy_utf8("b"), text.strict_utf8(F.col("b"))).collect()] == [("a\ufffd", None), ("é", "é"), (None, None)]
    secret = 'x\x01 Authorization: Bearer abc.def== and API_KEY="k k", sk-ant-0123456789ab token: zz'
    assert values(spark, [secret], analysis.redacted) == ['x\ufffd Authorization: Bearer [REDACTED] and API_KEY=[REDACTED], [REDACTED] token: [REDACTED]']
    assert values(spark, ['{"usage": {"input_tokens": 12}}', "{", "{}"], analysis.input_tokens) == [12.0, None, None]
    assert values(spark, ["0123456789"], lambda c: analysis.error_context(c, F.lit(5), 2)) == ["3456"]
    assert files.default_output("pdf", "a-1") == "data/logs/pdf/a-1.json"
    with pytest.raises(ValueError):
        files.default_output("pdf", "../x")
