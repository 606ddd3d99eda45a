"""Patterns and searches by index, networks by prefixes, masks of the same length, against plain loops."""

import ipaddress
import random
import re

import pytest
from pyspark.sql import functions as F

from fieldsieve.functions import addresses
from fieldsieve.operators import analysis, masking, patterns, rules


def some_texts():
    random.seed(3)
    words = ["the", "防災", "a", "ab", "abc", "tender", "x😀y", "notice", "2026", "é"]
    return ["".join(random.choice(words) + random.choice(["", " "]) for _ in range(random.randint(0, 12))) for _ in range(150)] + ["", None, "the"]


def test_patterns_equal_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(patterns, "PART", 10)  # frequent grams are dealt to parts
    monkeypatch.setattr(patterns, "TOGETHER", 5)
    texts = some_texts()
    found = ["the", "a", "ab", "防", "防災", "x😀y", "😀", "tender notice", "zzz", "", None, "abc the", "the", "2026é", " "] + [t[2:9] for t in texts[:40] if t]
    for groups in (1, 3):
        t = spark.createDataFrame([(i, None if i % 5 == 4 else f"g{i % groups}", x) for i, x in enumerate(texts)], "id long, grp string, text string")
        p = spark.createDataFrame([(i, None if i % 5 == 4 else f"g{i % groups}", x) for i, x in enumerate(found)], "pattern_id long, grp string, pattern string")
        want = {(a.id, b.pattern_id) for a in t.collect() for b in p.collect() if a.text and b.pattern and a.grp == b.grp and b.pattern in a.text}
        got = [tuple(r) for r in patterns.matches(t, p).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert patterns.matches(t, p.limit(0)).count() == 0 == patterns.matches(t.limit(0), p).count()
    plan = patterns.matches(t, p)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_reasons_equal_the_verdicts_by_row(spark):
    texts, sides = some_texts(), {"s0": (["the", "tender"], ["2026"]), "s1": (None, ["notice", "防"]), "s2": (["abc"], None), "s3": (None, None)}
    rows = [(i, f"s{i % 4}", x or "", *sides[f"s{i % 4}"]) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, grp string, text string, includes array<string>, excludes array<string>")
    want = {r.id: r.v for r in df.select("id", rules.title_verdict(F.col("text"), F.col("includes"), F.col("excludes")).alias("v")).collect()}
    p = spark.createDataFrame([(f"{g}{x}{k}", g, x, k == 1) for g, both in sides.items() for k, some in enumerate(both) for x in some or []], "pattern_id string, grp string, pattern string, excludes boolean")
    assert {r.id: r.reason for r in patterns.title_reasons(df.select("id", "grp", "text"), p).collect()} == want and len(set(want.values())) == 3


def test_searches_equal_a_plain_loop(spark):
    texts = some_texts()
    asked = [["the"], ["the", "防災"], ["a", "ab", "2026"], ["zzz", "the"], [], ["", "é"], ["the", "the"], ["x😀y", " "], None]
    t = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, terms array<string>")
    want = {(k, i) for k, terms in enumerate(asked) for i, x in enumerate(texts) if x and (some := [w for w in terms or [] if w]) and all(w in x for w in some)}
    got = [tuple(r) for r in patterns.search_many(t, q).collect()]
    assert len(got) == len(set(got)) and set(got) == want


ADDRESSES = ["::", "::1", "1::", "2001:DB8::5", "2001:db8:0:0:0:0:0:5", "::ffff:8.8.8.8", "64:ff9b::1.2.3.4", "fe80::1%eth0", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "8000::8000:0:0:1", "10.1.2.3", "255.255.255.255", "0.0.0.0"]
NONE = ["", "1", "1.2.3", "1.2.3.256", "01.2.3.4", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7:8::", "g::", "12345::", "1:2:3:4:5:6:7:1.2.3.4", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "::1.2.3.4.5", "::1.2.3.999", "a.b.c.d", None]


def test_addresses_as_numbers(spark):
    df = spark.createDataFrame([(x,) for x in ADDRESSES + NONE], "a string").withColumn("n", addresses.numbers(F.col("a")))
    for r in df.collect():
        if r.a in NONE:
            assert r.n is None, r.a
        else:
            a = ipaddress.ip_address(r.a.partition("%")[0])
            assert (r.n.version, (r.n.hi % (1 << 64)) << 64 | r.n.lo % (1 << 64)) == (a.version, int(a)), r.a


def test_networks_equal_a_plain_loop(spark):
    random.seed(9)
    nets = ["::/128", "fc00::/7", "2001:db8::/32", "2001:db8:1::/48", "2001:db8::/32", "8000::/1", "10.0.0.0/8", "10.1.0.0/16", "1.2.3.4", "::ffff:0:0/96", "0.0.0.0/32"]
    nets += [f"{random.randrange(1, 224)}.{random.randrange(256)}.0.0/{random.randint(9, 24)}" for _ in range(60)] + [f"2{random.randrange(4096):03x}:{random.randrange(65536):x}::/{random.randint(5, 64)}" for _ in range(60)]
    bad = ["10.0.0.0/33", "::/129", "x/8", "1.2.3.4/", None]
    some = ADDRESSES + NONE + [f"{random.randrange(256)}.{random.randrange(256)}.3.4" for _ in range(200)] + [f"2{random.randrange(4096):03x}:{random.randrange(65536):x}::{random.randrange(65536):x}" for _ in range(200)]
    known = [ipaddress.ip_network(n, strict=False) for n in nets]
    df = spark.createDataFrame(list(enumerate(some)), "net int, a string")
    got = {r.net: r.in_network for r in addresses.in_networks(df, "a", spark.createDataFrame([(n,) for n in nets + bad], "cidr string")).collect()}
    for k, x in enumerate(some):
        a = None if x in NONE else ipaddress.ip_address(x.partition("%")[0])
        assert got[k] == (None if a is None else any(a.version == n.version and a in n for n in known)), x
    outer = addresses.outermost(addresses.parsed_networks(spark.createDataFrame([(n,) for n in nets + bad], "cidr string")))
    assert outer.count() == len({n for n in known if not any(m != n and n.version == m.version and n.subnet_of(m) for m in known)})
    assert {r.in_network for r in addresses.in_networks(df, "a", spark.createDataFrame([], "cidr string")).collect()} == {False, None}


def test_masks_keep_every_offset(spark):
    secret = 'x\x01 é😀 Authorization: Bearer abc.def== and API_KEY="k k", sk-ant-0123456789ab token: zz; ' + "Q" * 40 + " end"
    texts = [secret, secret + secret, "", None, "no secret", "notion_token='a' ACCESS_TOKEN=b", "█ stays", "Bearer abc", "unbearer abcdef", "sk-0123456789", "ask-0123456789 sk-01234", "token=" + "z" * 50]
    rows = masking.masked(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string"), "text").withColumn("spans", masking.spans(F.col("masked"))).collect()
    one = "x� é😀 Authorization: Bearer █████████ and API_KEY=█████, " + "█" * 19 + " token: ███ " + "█" * 40 + " end"
    assert rows[0].masked == one and rows[1].masked == one + one and rows[2].masked == "" and rows[3].masked is None and rows[3].spans is None
    for r in rows:
        if r.text:
            assert len(r.masked) == len(r.text) and all(m == t or m in "█�" for m, t in zip(r.masked, r.text))
            assert [(s.begin, s.end) for s in r.spans] == [m.span() for m in re.finditer("█+", r.masked)]
    assert [r.masked for r in rows[4:]] == ["no secret", "notion_token=███ ACCESS_TOKEN=█", "█ stays", "Bearer ███", "unbearer abcdef", "█████████████", "ask-0123456789 sk-01234", "token=" + "█" * 50]
    around = spark.createDataFrame([(secret,)], "t string").select(analysis.error_context(F.col("t"), F.lit(40), 5).alias("x"), masking.masked_context("t", F.lit(40), 5).alias("y")).first()
    assert around.x in secret and around.y == one[35:45]
