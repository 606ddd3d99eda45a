"""Places of quotes: the normal form is Spark's, and each place holds its quote."""

import random

from pyspark.sql import functions as F

from fieldsieve.functions.text import for_evidence
from fieldsieve.operators import quotes

POOL = list("abcXY 09 \n\t.,“”‘’ éèñ") + ["ｶ", "ﾞ", "é", "e", "́", "가", "ᄀ", "ᅡ", "ᆨ", "①", "ﬁ", "㍿", "　", "ｆｕｌｌ", "日本", "﻿", "া", "ে", "😀", "½", "̧", "Å", "…", "\x85", " "]


def test_the_normal_form_is_the_one_of_evidence(spark):
    random.seed(4)
    texts = ["".join(random.choice(POOL) for _ in range(random.randint(0, 20))) for _ in range(2000)]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(for_evidence(F.col("t"))).collect()]
    for t, want in zip(texts, got):
        plain, begin, end = quotes.normal_places(t)
        assert plain == want and len(plain) == len(begin) == len(end) and begin == sorted(begin), ascii(t)
    for t in texts:  # what stands at a place is the quote again
        plain, begin, end = quotes.normal_places(t)
        if len(plain) > 4:
            a, b = sorted(random.sample(range(len(plain)), 2))
            q = plain[a : b + 1]
            place = quotes.places_of(t, [q])[0]
            if quotes.normal_places(q)[0] == q:
                assert place and q in quotes.normal_places(t[place[0] : place[1]])[0] and place[0] <= begin[a]


def test_quotes_of_a_table(spark):
    texts = spark.createDataFrame([(1, "html", "x  “Hello   wörld” 日 本\n語"), (1, "pdf", "other"), (2, "html", None), (3, "html", "same same")], "k int, source string, text string")
    asked = [(1, "html", '"Hello wörld"', 0), (1, "html", "日本語", 1), (1, "html", "zz", 2), (1, "html", "", 3), (1, "html", None, 4), (1, "pdf", "日本語", 5), (2, "html", "x", 6), (9, "html", "x", 7), (3, "html", "same", 8), (3, "html", "same", 9), (None, "html", "x", 10)]
    got = quotes.quote_places(spark.createDataFrame(asked, "k int, source string, quote string, begin int"), texts, ["k", "source"])
    assert got.columns == ["k", "source", "quote", "begin", "end"] and got.count() == len(asked)
    found = sorted((r.k, r.source, r.quote, r.begin, r.end) for r in got.collect() if r.begin is not None)
    assert found == [(1, "html", '"Hello wörld"', 3, 18), (1, "html", "日本語", 19, 24), (3, "html", "same", 0, 4), (3, "html", "same", 0, 4)]
    assert quotes.quote_places(got.limit(0), texts, ["k", "source"]).count() == 0
