"""Fingerprints, collocations and the manifest against brute force, with nulls, empty and long texts, repeats, empty tables and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from fieldsieve.llm import collocations as phrases, fingerprints, merkle_manifest, skew

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, leaf string, salt int, next string, place string, times int, piece string, id string"


def corpus():
    random.seed(5)
    vocab = [f"w{k}" for k in range(40)] + ["été", "Big", "big", "日本", "it's"]
    texts = [" ".join(random.choice(vocab) + random.choice(["", "", "", ".", ",", ".\n", "\n\n"]) for _ in range(random.randint(0, 300))) for _ in range(120)]
    texts += ["", None, " \t\n", "one", "Erinst resh.", "\n\n\n", "no end " * 500, "x" * 3000, "퟿😀" * 700, "a\r\nb\x0bc\x0cd", "A.B;C:D!E?F", "same old words here. " * 40] * 2
    texts += ["long " + " ".join(random.choice(vocab) for _ in range(9000))]
    rows = [(k, t, None if k % 9 == 0 else "en" if k % 2 else "fr", None if k % 7 == 0 else ("é" if k % 11 == 0 else f"s{k % 3}"), None if t is None else len(t), *"gl", 1, *"np", 2, *"pi") for k, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, "a null\nid", "en", "s0", 1, *"gl", 1, *"np", 2, *"pi"), (None,) * 13]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


# fingerprints

def tree(text, piece):
    sections = [[[sha(x) for x in re.findall(piece, p)] for p in re.findall(fingerprints.PARAGRAPH, s)] for s in re.findall(fingerprints.SECTION, text)]
    paragraphs = [[sha("".join(p)) for p in s] for s in sections]
    tops = [sha("".join(s)) for s in paragraphs]
    shape = "".join("/" + t[:16] + "".join(f".{h[:12]}x{len(p)}" for h, p in zip(hs, ps)) for t, hs, ps in zip(tops, paragraphs, sections))
    return sha("".join(tops)) + shape, "".join(x[:8] for s in sections for p in s for x in p)


def fingerprint(text):
    if len(text) <= fingerprints.SHORT:
        head, leaves = tree(text, fingerprints.FOURS if len(text) <= fingerprints.TINY else fingerprints.WORDS)
        return f"{head}|{leaves}|"
    head, leaves = tree(text, fingerprints.SENTENCE)
    words = "".join(sha(x)[:8] for p in re.findall(fingerprints.PARAGRAPH, text) for x in re.findall(fingerprints.WORDS, p)) if len(text) <= 2 * fingerprints.SHORT else ""
    return f"{head}|{words}|{leaves}"


def likeness(a, b):
    if a[:64] == b[:64]:
        return 1.0
    parts = lambda v: {v[i : i + 8] for i in range(0, len(v), 8)}
    x, y = a.split("|"), b.split("|")
    k = next((k for k in (1, 2) if x[k] and y[k]), 0)
    p, q = (parts(x[k]), parts(y[k])) if k else (set(re.findall(r"\.[0-9a-f]{12}", x[0])), set(re.findall(r"\.[0-9a-f]{12}", y[0])))
    return 2 * len(p & q) / (len(p) + len(q)) if p or q else 0.0


@pytest.mark.parametrize("size", [1024, 7])
def test_fingerprints(docs, monkeypatch, size):
    monkeypatch.setattr(fingerprints, "RANGE", size)
    rows = sorted(((r[0], r[1] or "") for r in corpus() if r[0] is not None), key=lambda r: (-r[0], r[1]))
    want = []
    for i, (k, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b = fingerprint(t), fingerprint(edited)
        want.append((k, len(t), sha(edited), a, b, likeness(a, b), likeness(a, fingerprint(after))))
    for r in corpus():
        if r[0] is None:
            t = r[1] or ""
            edited = t[: len(t) - len(t) // 2]
            a, b = fingerprint(t), fingerprint(edited)
            want.append((None, len(t), sha(edited), a, b, likeness(a, b), likeness(a, fingerprint(""))))
    got = [tuple(r)[:7] for r in fingerprints.fingerprint_digests(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_pieces_cover_texts():
    for text in [r[1] for r in corpus() if r[1]]:
        for pattern in (fingerprints.SECTION, fingerprints.PARAGRAPH, fingerprints.SENTENCE, fingerprints.WORDS, fingerprints.FOURS):
            assert "".join(re.findall(pattern, text)) == text, pattern


def test_edits_are_located(spark, empty):
    lines = [f"Line {k} of the text. It has two sentences." for k in range(40)]
    other = list(lines)
    other[20] = "Something else."
    df = spark.createDataFrame([("\n".join(lines), "\n".join(other)), ("\n".join(lines), "\n".join(lines[:20] + lines[21:])), ("a", "a"), ("", "b"), (None, "")], "a string, b string")
    got = [[tuple(e) for e in r.e] for r in df.select(fingerprints.edits(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("e")).collect()]
    assert got == [[(1, 4)], [(1, 4)], [], [], []]
    assert fingerprints.fingerprint_digests(empty).collect() == [] and fingerprints.document_fingerprints(df.withColumn("doc_id", F.lit(1)), text_col="a").select("fingerprint").distinct().count() == 3


def test_edited_texts_are_nearer_than_others(spark):
    got = fingerprints.fingerprint_digests(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert sum(r.near_edited > r.near_next for r in got) >= 0.99 * len(got)


# collocations

def mined(rows, longest, least, pct, top):
    grams, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, *_ in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                grams[lang or "und"].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in grams.items():
        f = {p: c for p, c in f.items() if c >= least}
        found = []
        for p, a in f.items():
            w = p.split(" ")
            if len(w) < 2:
                continue
            inside = [q for q in f if len(q.split(" ")) > len(w) and f" {p} " in f" {q} "]
            if any(100 * f[q] >= pct * a for q in inside):
                continue
            cuts = [(2_000_000 * a // (f[" ".join(w[:k])] + f[" ".join(w[k:])]), k, f[" ".join(w[:k])], f[" ".join(w[k:])]) for k in range(1, len(w))]
            score, _, left, right = min(cuts)
            found.append((score, a, p, left, right))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, left, right, n[lang], score) for i, (score, a, p, left, right) in enumerate(found[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("longest,least,part,slots", [(4, 5, 1024, 1 << 26), (4, 3, 16, 1 << 16), (2, 8, 16, 1 << 20), (5, 10, 64, 1 << 26)])
def test_collocations(docs, monkeypatch, longest, least, part, slots):
    """Also where long pieces are in parts, and where the bitmap lets everything through."""
    monkeypatch.setattr(phrases, "PART", part)
    monkeypatch.setattr(phrases, "SLOTS", slots)
    monkeypatch.setattr(skew, "SHARE", 1 / 50)
    got = sorted(tuple(r)[:8] for r in phrases.collocations(docs, longest, least, top=50).collect())
    assert got == mined(corpus(), longest, least, 80, 50) and len(got) > 20


def test_collocations_of_large_counts_and_empty_tables(spark, empty):
    assert phrases.collocations(empty).collect() == []
    df = spark.createDataFrame([("x y z w v u t s. " * 2000, "en")], "text string, lang string")
    assert [tuple(r)[:5] for r in phrases.collocations(df).collect()] == [("en", i, p, 2000, 2000) for i, p in enumerate(sorted(" ".join("xyzwvuts"[i : i + 4]) for i in range(5)), 1)]


# manifest

def manifest(rows, fan_out):
    field = lambda v: "-" if v is None else f"{len(str(v).encode('utf-8', 'surrogatepass'))}:{v}"
    leaf = lambda r, text: sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + fan_out])) for i in range(0, len(out[-1]), fan_out)])
        return out

    def path(lv, i):
        for row in lv[:-1]:
            a = i // fan_out * fan_out
            run = row[a : a + fan_out]
            yield run[: i - a], run[i - a + 1 :]
            i //= fan_out

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[3]].append(r)
    keys = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([leaf(r, r[1]) for r in groups[s]]) for s in keys if groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) is None}
    top = levels([trees[s][-1][0] for s in keys])
    for k, s in enumerate(keys):
        for i, r in enumerate(groups[s]):
            steps, text = [*path(trees[s], i), *path(top, k)], r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf(r, text)
            for a, b in steps:
                node = sha("".join(a) + node + "".join(b))
            yield r[0], leaf(r, r[1]), trees[s][-1][0], top[-1][0], sha("".join("".join(a) + "".join(b) for a, b in steps)), node, node == top[-1][0]


@pytest.mark.parametrize("shard,levels", [(100_000, 5), (7, 2)])
def test_manifest(docs, monkeypatch, shard, levels):
    """Also with many small shards, so that groups cross them and upper levels take rounds."""
    monkeypatch.setattr(merkle_manifest, "SHARD", shard)
    monkeypatch.setattr(merkle_manifest, "LEVELS", levels)
    got = sorted((tuple(r) for r in merkle_manifest.manifest_digests(docs).collect()), key=repr)
    assert got == sorted(manifest(corpus(), 3), key=repr)
    assert 0 < sum(r[-1] for r in got) < len(got)


def test_manifest_of_one_group_and_other_fan_outs(spark, empty, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "SHARD", 10)
    assert merkle_manifest.manifest_digests(empty).collect() == []
    df = spark.range(101).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("x").alias("text"))
    for fan_out in (2, 16):
        out = merkle_manifest.merkle_manifest(df, ["doc_id", "text"], fan_out=fan_out)
        got = out.select(merkle_manifest.folded(F.col("proof"), F.col("leaf")).alias("f"), "root", "subroot", F.size("proof").alias("n")).distinct().collect()
        assert len({r.root for r in got}) == 1 and all(r.f == r.root == r.subroot for r in got) and {r.n for r in got} == {merkle_manifest.height(101, fan_out)}


def test_places_of_groups():
    ends = [(2, [(b"b", 4), (b"d", 1)]), (0, [(b"a", 3)]), (1, [(b"a", 2), (b"b", 5)]), (3, []), (4, [(b"d", 2)])]
    assert merkle_manifest.group_places(ends) == {0: (0, [5]), 1: (3, [5, 9]), 2: (5, [9, 3]), 4: (1, [3])}
