"""Requests against a server of this machine, and redirects over a table of answers."""

import http.server
import threading
import time

import pytest
from pyspark.sql import functions as F

from fieldsieve.sources import fetching
from fieldsieve.sources.fetching import Settings

SEEN: list[tuple[float, str]] = []


class Handler(http.server.BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"

    def do_GET(self):
        SEEN.append((time.monotonic(), self.path))
        if self.path == "/moved":
            self.send_response(302)
            self.send_header("location", "/ok")
            self.send_header("content-length", "0")
            self.end_headers()
        elif self.path == "/slow":
            self.send_response(200)
            self.send_header("content-length", "100")
            self.end_headers()
            for _ in range(20):
                self.wfile.write(b"x")
                self.wfile.flush()
                time.sleep(0.2)
        elif self.path in ("/flood", "/declared"):
            self.send_response(200)
            if self.path == "/declared":
                self.send_header("content-length", str(1 << 30))
            self.send_header("connection", "close")
            self.end_headers()
            try:
                for _ in range(1000):
                    self.wfile.write(b"y" * 10_000)
            except OSError:
                pass
        else:
            body = {"/empty": b"", "/ok?q=1": "é".encode()}.get(self.path, b"fine")
            self.send_response(404 if self.path == "/gone" else 200)
            self.send_header("content-type", "text/html")
            self.send_header("content-length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def server():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


LOCAL = Settings(timeout=2, most_bytes=100_000, gap_ms=0, trusted=("127.0.0.1",))


def test_one_request(server):
    got = {p: fetching.get(server + p, LOCAL) for p in ("/ok?q=1", "/moved", "/gone", "/empty", "/flood", "/declared")}
    assert got["/ok?q=1"]["content"].decode() == "é" and got["/ok?q=1"]["response_bytes"] == 2 and got["/ok?q=1"]["error"] is None and got["/ok?q=1"]["content_type"] == "text/html"
    assert (got["/moved"]["http_status"], got["/moved"]["location"], got["/moved"]["content"]) == (302, "/ok", None) and got["/gone"]["http_status"] == 404
    assert [got[p]["error"] for p in ("/empty", "/flood", "/declared")] == ["empty", "too_large", "too_large"]
    began = time.monotonic()
    assert fetching.get(server + "/slow", LOCAL)["error"] == "timeout" and time.monotonic() - began < 3.5
    assert fetching.get(server + "/ok", Settings(timeout=2))["error"] == "blocked_address"  # this machine's own addresses are reserved
    assert fetching.get("http://no-such-host.invalid/", LOCAL)["error"] == "unresolved" and fetching.get("http://127.0.0.1:1/", LOCAL)["error"] == "connection"
    assert [fetching.blocked(a) for a in ("10.1.2.3", "::ffff:8.8.8.8", "fe80::1%eth0", "8.8.8.8", "2600::1")] == [True, True, True, False, False]


def test_the_source_deals_hosts_and_waits(spark, server):
    fetching.register(spark)
    other = server.replace("127.0.0.1", "localhost")
    urls = [f"{server}/a{k}" for k in range(4)] + [f"{other}/b{k}" for k in range(3)] + [f"{server}/a0"]
    del SEEN[:]
    df = spark.read.format("pages").option("urls", "\n".join(urls)).option("gapMs", 300).option("trusted", "127.0.0.1,::1").load()
    assert df.rdd.getNumPartitions() == 2
    rows = df.collect()
    assert sorted(r.url for r in rows) == sorted(set(urls)) and {bytes(r.content) for r in rows if "/a" in r.url} == {b"fine"}
    for host in ("/a", "/b"):
        at = sorted(t for t, p in SEEN if p.startswith(host))
        assert all(b - a >= 0.29 for a, b in zip(at, at[1:]))
    assert spark.read.format("pages").load().count() == 0


def test_pages_are_read_once_and_followed(spark, server, tmp_path):
    del SEEN[:]
    urls = spark.createDataFrame([(server + p,) for p in ("/ok?q=1", "/moved", "/gone", "/ok?q=1")] + [(None,)], "url string")
    path = str(tmp_path / "store")
    for _ in range(2):
        got = fetching.read_pages(urls, LOCAL, path)
        assert got.count() == 3 and got.filter("response_bytes = 2").count() == 1
    assert len(SEEN) == 3
    asked = urls.withColumn("k", F.monotonically_increasing_id()).withColumn("domains", F.array(F.lit("127.0.0.1")))
    # a host that is an address is refused before anything is asked
    assert {r.error for r in fetching.follow(asked, lambda u: fetching.read_pages(u, LOCAL), ["k"]).collect()} == {"address", "scheme"} and len(SEEN) == 3


def test_redirects_over_a_table(spark):
    hops = [(f"https://a.example/{k}", 302, f"/{k + 1}", None, 0) for k in range(6)] + [("https://a.example/6", 200, None, b"end", 3), ("https://a.example/loop", 301, "loop", None, 0), ("https://a.example/out", 307, "http://evil.test/x", None, 0)]
    hops += [("https://a.example/number", 302, "http://0x7f.1/", None, 0), ("https://a.example/none", 303, None, None, 0), ("https://a.example/login", 308, "https://u:p@a.example/6", None, 0), ("https://a.example/ftp", 302, "ftp://a.example/", None, 0), ("https://a.example/big", 200, None, b"x", 10**9)]
    hops += [(f"https://a.example/hot{k}", 302, "/6", None, 0) for k in range(3000)]
    answers = spark.createDataFrame([(u, s, w, None, c, n, None, None, None) for u, s, w, c, n in hops], fetching.RESPONSE)
    names = ["0", "1", "loop", "out", "number", "none", "login", "ftp", "big", "missing"] + [f"hot{k}" for k in range(3000)]
    asked = spark.createDataFrame([(k, f"HTTPS://A.example:443/x/../{n}#part", ["a.example"]) for k, n in enumerate(names)] + [(9999, None, None)], "k int, url string, domains array<string>")
    got = {r.k: (r.final_url, r.hops, r.error) for r in fetching.follow(asked, fetching.from_table(answers), ["k"]).collect()}
    assert got[0] == ("https://a.example/5", 5, "redirects") and got[1] == ("https://a.example/6", 5, None) and got[2] == ("https://a.example/loop", 5, "redirects")
    assert [got[k][2] for k in range(3, 10)] == ["domain", "address", "no_location", "credentials", "scheme", "too_large", "unanswered"] and got[9999] == (None, 0, "scheme")
    assert {got[k] for k in range(10, 3010)} == {("https://a.example/6", 1, None)}
    assert fetching.follow(asked.limit(0), fetching.from_table(answers), ["k"]).count() == 0
