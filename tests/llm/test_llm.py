"""The ten operators and the pipeline against brute force, on small tables with nulls, empty texts, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldsieve.llm import bpe, bpe_codec, fm_index, language_id, near_dedup, packing, pii, quality_rules, skew, substring_dedup, token_counts, topk_search, toxicity, words
from fieldsieve.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, label string, a int, kept int, rank string, score string"


def corpus():
    random.seed(11)
    vocab = ["w%d" % k for k in range(300)] + ["Été", "Straße", "naïve,", "x.", "# $"]
    texts = [" ".join(random.choice(vocab) for _ in range(random.randint(0, 160))) for _ in range(60)]
    base = texts[3].split() + ["tail"] * 3 + [f"b{k}" for k in range(90)]
    for k in range(25):  # near copies of different strength
        copy = list(base)
        for _ in range(k // 2):
            copy[random.randrange(len(copy))] = f"new{random.randrange(10**6)}"
        texts.append(" ".join(copy))
    passage = " ".join(f"p{k}" for k in range(45))
    texts += [f"a{k} b{k} c{k} {passage} d{k}\n e{k}" for k in range(12)]
    texts += ["", None, " \t\n", "one", "one", "one two", "Ünï　code 😀", "w1 " * 400, "line\nline\n\nline\n", "w1 w2 w3 " * 20, "same text of words " * 9, "same text of words " * 9]
    texts += ["long " + "".join(random.choice("abc \n") for _ in range(30000))]
    rows = [(k, t, None if k % 9 == 0 else "en", None if k % 7 == 0 else f"s{k % 2}", 1, "k", "l", 1, 2, "r", "s") for k, t in enumerate(texts)]
    return rows + [rows[5], (None, "a null id", "en", "s", 1, "k", "l", 1, 2, "r", "s"), (None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_by_id():
    return {r[0]: r[1] or "" for r in corpus() if r[0] is not None}


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize("k,num", [(3, 85), (5, 80)])
def test_near_duplicates(docs, k, num):
    sets = {i: shingles(t, k) for i, t in texts_by_id().items()}
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    got = near_dedup.near_duplicates(docs, k, num, 100).collect()
    assert len(got) == len(corpus())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)


def thue_morse(n):
    """Two words of n letters that meet in any hash that sums letters times powers of an odd number modulo 2**64."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_of_regular_letters_differ(spark):
    for n in (1024, 2048):
        x, y = thue_morse(n)
        around = [f"v{k}" for k in range(30)]
        df = spark.createDataFrame([(k, " ".join(around[:15] + [w] + around[15:])) for k, w in enumerate((x, y))], "doc_id long, text string")
        assert [r.n_removed for r in substring_dedup.substring_digests(df, 20).collect()] == [0, 0]
        both = spark.createDataFrame([(0, x), (1, y)], "doc_id long, text string")
        assert near_dedup.near_duplicates(both).filter("kept").count() == 2


@pytest.mark.parametrize("cells,share,shard", [(1 << 18, skew.SHARE, 1 << 16), (256, 0.01, 50)])
def test_substring_dedup(docs, monkeypatch, cells, share, shard):
    monkeypatch.setattr(substring_dedup, "CELLS", cells)
    monkeypatch.setattr(substring_dedup, "PART", 128)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
    monkeypatch.setattr(substring_dedup, "with_value", lambda *a: skew.with_value(*a, share))
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(substring_dedup)  # so that workers see these numbers
    try:
        substring_against_a_scan(docs)
    finally:
        cloudpickle.unregister_pickle_by_value(substring_dedup)


def substring_against_a_scan(docs):
    seen, want = set(), {}
    for i, t in sorted(texts_by_id().items()):
        w = WORD.findall(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(g)
        kept = " ".join(x for x, y in zip(w, gone) if not y)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = substring_dedup.substring_digests(docs, 20).collect()
    assert len(got) == len(corpus()) and all(want[r.doc_id] == tuple(r)[1:] for r in got if r.doc_id is not None)
    assert [r.n_removed for r in got if r.doc_id is None] == [0, 0]


def test_cut_texts_keep_what_stays(docs):
    out = substring_dedup.drop_repeats(docs, 20)
    assert out.columns == docs.columns
    digests = {r.doc_id: r.kept_sha256 for r in substring_dedup.substring_digests(docs, 20).collect()}
    for r in out.collect():
        if r.doc_id is not None:
            assert hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest() == digests[r.doc_id]


def test_fm_index_counts_as_a_scan():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 6, 400).astype(np.uint64)
    ends = np.array([100, 130, 400])
    index = fm_index.FMIndex(text, ends, 8)
    begin = {0: 0, 1: 100, 2: 130}
    for seg, k in ((0, 10), (1, 105), (2, 200), (2, 390)):
        place = np.array([index.starts[seg] + k - begin[seg]])
        matched, lo, hi = index.matching(place, np.array([4]), 1)
        want = sum((text[a : a + 4] == text[k : k + 4]).all() for s, e in ((0, 100), (100, 130), (130, 400)) for a in range(s, e - 3))
        assert matched[0] == 4 and hi[0] - lo[0] == want


@pytest.fixture(scope="module")
def codec():
    raw = bpe.load(tokenizer_path())
    model = bpe.WordBpe(raw)
    seen = collections.Counter(p for t in odd_texts() for p in model.split(t)[0])
    pieces = sorted({p.encode() for p, n in seen.items() if n > 1 and p not in model.special} | set(model.whole_words()[::3]))
    return raw, bpe.compile_lexicon(model, model.whole_words()), token_counts.compile_transducer(model, pieces)


def odd_texts():
    random.seed(5)
    letters = "aAbß éÉ'sS'llΣσς \u0085\u001c İıǅ²½٣一二ȩ́🎉👩‍👩\t\n\x0b\x00_-.,#ﬁÅΩⅣͅ<|>"
    out = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(400)]
    return out + list(texts_by_id().values()) + ["the <|endoftext|> cat's<|startoftext|>'re", "<|endoftext|>", "a" * 3000, "the of and " * 50]


def test_codec_and_counts_equal_the_library(codec):
    import tokenizers

    lib, texts = tokenizers.Tokenizer.from_file(tokenizer_path()), odd_texts()
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    mine = bpe_codec.Codec(codec[0], codec[1])
    for text, ids, (n, spelled, decoded) in zip(texts, want, mine.spelled(texts)):
        assert (n, spelled, decoded) == (len(ids), " ".join(map(str, ids)), lib.decode(ids, skip_special_tokens=False)), text
    assert mine.decode(want[3]) == lib.decode(want[3], skip_special_tokens=False)
    counter = token_counts.Counter(codec[0], codec[2])
    for text, ids in zip(texts, want):
        raw, some = text.encode(), random.Random(len(text))
        s, e, _ = words.word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert counter.words(np.frombuffer(raw, np.uint8), s, e).sum() == len(ids), text
        for size in {1, 2, 3, 7, 16, some.randint(1, 40)} if len(raw) < 4000 else {501}:
            maps = [counter.map_of(raw[k : k + size]) for k in range(0, len(raw), size)]
            if maps:
                assert counter.total(counter.composed(maps)) == len(ids), (text, size)
                # any bracketing gives the same
                left = maps[0]
                for m in maps[1:]:
                    left = counter.compose(left, m)
                assert counter.total(left) == len(ids), (text, size)
    for text in ("the cat's 'real' swims, don't! 42% ''s'll 're' 'v 'Ve", "naïve été über—straße. A1b2", "<|endoftext|>the<|startoftext|>cat"):  # cut at every place
        raw, n = text.encode(), len(lib.encode(text, add_special_tokens=False).ids)
        for k in range(1, len(raw)):
            for m in range(k + 1, len(raw)):
                assert counter.total(counter.composed([counter.map_of(x) for x in (raw[:k], raw[k:m], raw[m:])])) == n, (text, k, m)


def test_lexicon_is_exact_and_minimal(codec):
    model, lexicon = bpe.WordBpe(codec[0]), bpe.Lexicon(codec[1])
    some = model.whole_words()[::97]
    assert lexicon.ids(some) == [model.merge(w.decode()) for w in some] and lexicon.ids([b"qqqzzzq", b""]) == [None, None]
    trie = {w[:k] for w in model.whole_words() for k in range(len(w) + 1)}
    assert len(codec[1]["final"]) < len(trie) / 2


def test_codec_queries(docs):
    import tokenizers

    lib, want = tokenizers.Tokenizer.from_file(tokenizer_path()), texts_by_id()
    got = bpe_codec.bpe_digests(docs, tokenizer_path()).collect()
    counts = token_counts.token_counts(docs, tokenizer_path(), 100).collect()
    assert len(got) == len(counts) == len(corpus())
    for r in got:
        if r.doc_id is not None:
            ids = lib.encode(want[r.doc_id], add_special_tokens=False).ids
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    for r in counts:
        if r.doc_id is not None:
            n = len(lib.encode(want[r.doc_id], add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(want[r.doc_id].encode()), n, n > 100)


def test_packing(docs):
    import tokenizers

    lib, want = tokenizers.Tokenizer.from_file(tokenizer_path()), texts_by_id()
    rows = packing.packed_documents(docs, tokenizer_path(), 64, 1).collect()
    by_bin, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_bin[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for x in by_bin.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 64
    total = sum(r.length for r in rows)
    assert len(by_bin) <= 1.01 * total / 64 + 2
    for i, t in want.items():
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for r in by_doc[i]:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.start == r.piece * 64


def test_fullest_bins():
    random.seed(9)
    for _ in range(200):
        hist = collections.Counter(random.randint(1, 30) for _ in range(random.randint(1, 12)))
        lengths = sorted(hist, reverse=True)
        taken = dict(packing.fullest(dict(hist), lengths, 30, lengths[0]))
        sums = {0}
        for x, c in hist.items():
            sums = {s + x * k for s in sums for k in range(c - (x == lengths[0]) + 1)}
        assert sum(x * k for x, k in taken.items()) == lengths[0] + max(s for s in sums if s + lengths[0] <= 30) and all(hist[x] >= k for x, k in taken.items())


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.normal(0, 0.2, 16)], 1) for k in range(700)]
    rows += [(700, None, 1), (701, [1.0, None] * 8, 1), (702, [float("nan")] * 16, 1), (703, [float("inf")] * 16, 1), (705, [], 1), (706, [0.5] * 3, 1), (710, [0.25] * 3, 1), *[(800 + k, rows[20][1], 1) for k in range(15)]]
    # components beyond 64 bits whose products cancel, or aren't met; repeated rows
    rows += [(720, [1e301, -1e301] + [0.5] * 14, 1), (730, [3e16, 3e16] + [0.25] * 14, 1), (731, [1e301, 1e301] + [0.0] * 14, 1), (740, [-1e308] * 2 + [0.0] * 14, 1), rows[20], rows[20]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(4)
    x = {i: [topk_search.whole(c, 1024) for c in v] for i, v, _ in rows if v and None not in v and np.isfinite(v).all()}
    assert x[720][0] == 1024 * int(1e301) and x[0] == np.floor(1024 * np.array(rows[0][1])).astype(int).tolist()
    got = collections.defaultdict(list)
    for r in topk_search.top_k(df, 10, 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    clip = lambda n: min(max(n, -(1 << 63)), (1 << 63) - 1)
    for q in [i for i in x if i % 10 == 0]:
        best = sorted(((-clip(sum(a * b for a, b in zip(x[q], x[c]))), c) for c in x if c != q and len(x[c]) == len(x[q])))[:10]
        assert got[q] == [(c, -s) for s, c in best], q
    assert topk_search.top_k(df.limit(0)).count() == 0
    assert topk_search.top_k(df.filter("vec_id < 3").selectExpr("*", "'s' AS score", "1 AS part", "1 AS kind", "1 AS x"), 10, 1).count() == 6


def test_bounds_hold_and_spare_products():
    rng = np.random.default_rng(3)
    a, b = rng.integers(-500, 500, (20, 37)), rng.integers(-500, 500, (30, 37))
    sa, sb = topk_search.Statistics(a), topk_search.Statistics(b)
    true = ((a[:, None] - b[None]) ** 2).sum(2)
    low = [topk_search.lower_bounds(x, sa.norm, y, sb.norm) for x, y in zip(sa.levels, sb.levels)]
    assert all((x <= true).all() for x in low)
    # smooth vectors: segments tell most of their distances
    smooth = np.cumsum(rng.normal(0, 0.1, (3000, 64)), 1)
    smooth /= np.linalg.norm(smooth, axis=1)[:, None]
    q, c = (topk_search.Vectors.of(np.arange(lo, hi), smooth[lo:hi], 1024) for lo, hi in ((0, 200), (200, 3000)))
    for sparse in (1, 16, 1 << 30):
        topk_search.SPARSE, best = sparse, topk_search.Best(np.full(200, -np.inf), 10)
        head, rest = (topk_search.Vectors.of(c.ids[x], c.raw[x], 1024) for x in (slice(0, 500), slice(500, None)))
        topk_search.search_block(best, q, head, 1024)
        products = topk_search.search_block(best, q, rest, 1024)
        assert products < 0.3 * 200 * 2300
        assert (best.score == np.sort(q.x @ c.x.T, 1)[:, ::-1][:, :10]).all()
    topk_search.SPARSE = 16


def test_quality_rules(docs):
    got = quality_rules.line_frequency_rules(docs, max_docs=3, least_left=0.3).collect()
    assert len(got) == len(corpus())
    for r in got:
        t = texts_by_id()[r.doc_id] if r.doc_id is not None else ""
        if r.doc_id is None:
            continue
        w = WORD.findall(t)
        g = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        cover = {j for k in range(len(w) - 2) if g[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_frequent_lines_deplete(spark):
    line, body = "menu home about contact " * 20, lambda k: " ".join(chr(97 + k) * (j % 9 + 1) + chr(97 + j % 26) for j in range(80))
    rows = [(k, line + "\n" + (body(k) if k % 2 else f"tiny {k}"), "h") for k in range(10)] + [(10, line, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.line_frequency_rules(df, max_docs=3, max_repeat_pct=101).collect()}
    assert kept == {k: k % 2 == 1 or k in (0, 10) for k in range(11)}


def test_toxicity():
    rng = random.Random(1)
    plain = lambda: " ".join(rng.choice("the of and house river light stone window".split()) for _ in range(60))
    texts = [plain() for _ in range(60)] + [plain() + " you Stupid1 zonk zonker " + plain() for _ in range(30)] + [plain() + " zonk street " for _ in range(6)]
    lexicon = toxicity.learn(texts, [0] * 60 + [1] * 30 + [0] * 6)
    a = lexicon.automaton()
    score = lambda t: toxicity.score(lexicon, a, t)
    assert score(plain()) < 0.5 < 0.7 < score(plain() + " ѕtυpid1 z0nk ZONKER") and score(None) == score("") < 0.7
    assert toxicity.folded("Ѕtup1d, M0R0N!! sc@m 42") == " stupid moron scam a "[:0] + toxicity.folded("stupid moron scam 42") and toxicity.learn([], []).weights == {}
    assert score(plain() + " zonk street") < 0.7


def test_hits_of_a_very_long_text():
    """Five megabytes with hundreds of thousands of hits and exceptions, against the plain comparison on a part."""
    import time

    lexicon = toxicity.Lexicon({" bad ": 2.0, " worse": 1.0}, [" not bad ", " bad luck "])
    automaton = lexicon.automaton()
    part = " " + "not bad x bad luck bad worse y not bad luck " * 50
    found, spared = [], []
    for end, (w, n) in automaton.iter(part):
        (found if w else spared).append((end - n + 1, end + 1, w))
    assert sorted(toxicity.hits(automaton, part)) == sorted(x for x in found if not any(a <= x[0] and x[1] <= b for a, b, _ in spared)) and spared
    text = " " + "not bad x bad luck bad worse y " * 170_000
    began = time.perf_counter()
    assert len(toxicity.hits(automaton, text)) == 340_000 and time.perf_counter() - began < 10


def test_toxicity_learns_long_words_and_counts_labels_once(spark):
    word = "x" * 200
    docs = spark.createDataFrame([(k, f"{'quiet words here' if k % 2 else word + ' there'} {k}") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(60)] + [(1, 0)] * 50, "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels)
    assert rows.count() == rows.distinct().count()
    got = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(docs, toxicity.fit(docs, labels)).collect()}
    assert got == {k: 1 - k % 2 for k in range(60)}


def test_toxicity_folds_each_look_alike_alone():
    for c, plain in toxicity.LOOK_ALIKES.items():
        assert toxicity.folded(f"x{c}x") == f" x{plain}x ", c
    # folding a text doesn't hang on what else is in it
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x30000)]):
        assert toxicity.folded(f"x{c}x") + "x " == toxicity.folded(f"x{c}x х"), c
    lexicon = toxicity.Lexicon({" disgusting ": 5.0, " trash ": 5.0}, [], (-4.0, 2.0, 1.0))
    a = lexicon.automaton()
    assert all(toxicity.score(lexicon, a, t) > 0.7 for t in ("so dısgusting", "so trɑsh", "so disɡusting", "so dɩsgusting", "so traſh"))
    assert toxicity.score(lexicon, a, "so naïve, été") < 0.1


def test_languages(spark):
    rng = random.Random(2)
    sounds = {"en": "th ing and er the wh".split(), "de": "ich sch ung ein ver".split(), "fr": "eau oux ment que le".split(), "es": "cion ado los que ez".split()}
    make = lambda c: " ".join("".join(rng.choice(sounds[c]) for _ in range(2)) for _ in range(40))
    rows = [(k, make(c), c) for k, c in enumerate(rng.choice(list(sounds)) for _ in range(400))] + [(900, None, "en"), (901, "12 34 !!", "en"), (902, "", None), (None, make("fr"), "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language_id.predicted_languages(df, language_id.fit(df)).collect()
    lang = {r[0]: r[2] for r in rows}
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(out) == len(rows) and len(held) > 40 and sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95
    assert {r.lang_pred for r in out if r.doc_id in (900, 901, 902)} == {"und"} and all(0 <= r.score <= 1 for r in out)
    none = df.limit(0)
    assert language_id.predicted_languages(df, language_id.fit(none)).filter("lang_pred <> 'und'").count() == 0


def test_surrogates():
    text = "Mail Bob.Lee@corp.io or bob@mail1.example.com, +1 (017) 555-7713, 97.51.17.173, 4111111111111111, token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" Mrs. Smith met Mr Smith and Mme Иванова. Version 1.2.3.4.5, page 4.0."
    new, pairs = pii.replaced(text)
    assert {e.kind for e, _ in pairs} == {"email", "phone", "ip", "card", "secret", "name"} and all(e.value not in new for e, _ in pairs)
    assert "1.2.3.4.5" in new and new.endswith("page 4.0.") and pii.replaced(text)[0] == new and pii.replaced(text, b"other")[0] != new
    of = {e.kind: s for e, s in pairs}
    assert re.fullmatch(r"\+1 \(\d{3}\) 555-\d{4}", of["phone"]) and pii._luhn(of["card"][:-1]) == int(of["card"][-1]) and re.fullmatch("[0-9a-f]{40}", of["secret"])
    assert all(0 <= int(x) < 256 for x in of["ip"].split(".")) and of["email"].endswith("@mail1.example.com")
    shaped = [pii.same_shape(pii.KEY, "t", f"{k:04d}") for k in range(10000)]
    assert len(set(shaped)) > 9990
    assert len({pii._name(pii.KEY, n, "") for n in ("Anna", "Annb", "Bo", "Boo", "Marie", "Иванова", "Muller", "Müller")}) == 8
    assert pii.replaced(None) == (None, []) and pii.replaced("") == ("", [])


def test_surrogates_are_distinct_and_new():
    for values in ([f"{k:04d}" for k in range(10000)], [f"{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"], list("0123456789")):
        shaped = [pii.same_shape(pii.KEY, "t", v) for v in values]
        assert set(shaped) == set(values) and not any(a == b for a, b in zip(values, shaped))
    new = lambda kind, values: [pii.surrogate(pii.Entity(kind, 0, 0, v)) for v in values]
    for kind, values in (
        ("email", [f"{a}{b}@corp.io" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]),
        ("phone", [f"555-12{k:02d}" for k in range(100)] + [f"{k:03d}-5550" for k in range(1000) if k != 555]),
        ("secret", [f"1{k:07x}" for k in range(0, 1 << 16, 7)] + [f"{k:08d}" for k in range(9000)]),
    ):
        made = new(kind, values)
        assert len(set(made)) == len(set(values)) and not any(a == b for a, b in zip(values, made))
    assert all(x.startswith("555-") for x in new("phone", [f"555-12{k:02d}" for k in range(100)]))
    # a surname has one surrogate, whatever the honorific and also bare; a given name goes with the gender
    names = lambda t: [s for _, s in pii.replaced(t)[1]]
    assert len(set(names("Smith said: Mr Smith, Mrs Smith, then Dr Smith met Smith and SMITHSON."))) == 1 and len(names("Mr Smith met Smith.")) == 2
    woman, man, neither = (names(f"{h} Anna Smith")[0] for h in ("Mrs", "Mr", "Dr"))
    assert len({woman, man, neither}) == 3 and {x.split()[1] for x in (woman, man, neither)} == set(names("Mr Smith")) and names("Mrs Smith, Dr Anna Smith")[1] == woman
    assert woman[: woman.index(" ")][-1] in "ae" and man[: man.index(" ")][-1] in "nr"


def test_no_value_is_left_in_a_generated_corpus(spark):
    rng = random.Random(7)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    digits, low = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    scripts = [low, low + "éüñß", "".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x3B1, 0x3CA))), "".join(map(chr, range(0x561, 0x587))), "".join(map(chr, range(0x4E00, 0x4E80)))]

    def iban():
        account = pick(digits, 18)
        return f"DE{98 - int(account + '131400') % 97:02d}{account}"

    def card():
        body = pick(digits, 15)
        return body + str(pii._luhn(body))

    makers = {
        "email": lambda: f"{pick(rng.choice(scripts), rng.randint(2, 7))}@{pick(low, 4)}.org", "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), "ip6": lambda: ":".join(f"{rng.randint(0, 65535):x}" for _ in range(7)) + ":1",
        "iban": iban, "card": card, "ssn": lambda: f"{pick(digits, 3)}-{pick(digits, 2)}-{pick(digits, 4)}", "key": lambda: "AKIA" + pick(digits + low.upper(), 16), "phone": lambda: f"+1 {pick('2346789', 3)}-555-{pick(digits, 4)}",
        "hex": lambda: "1" + pick("0123456789abcdef", 39), "name": lambda: pick(rng.choice(scripts[:4]), rng.randint(3, 8)).capitalize(),
    }
    values = {kind: sorted({make() for _ in range(60)}) for kind, make in makers.items()}
    made: dict = {kind: {} for kind in values}
    rows = []
    for k in range(300):
        some = [(kind, rng.choice(v)) for kind, v in values.items()]
        text = " ; ".join(f"Dr {v} and later {v}" if kind == "name" else f"see {v.upper() if kind == 'email' and k % 2 else v} here" for kind, v in some)
        rows.append((k, text))
        new, pairs = pii.replaced(text)
        assert [e.kind for e, _ in pairs] == [kind for kind in values for _ in range(2 if kind == "name" else 1)], text
        for kind, v in some:
            assert v.lower() not in re.split("[ ;]+", new.lower()), (kind, v, new)
        for e, s in pairs:
            assert made[e.kind].setdefault(pii._identity(e), pii._spelling(e, s)) == pii._spelling(e, s)
            assert len(s) <= 2.5 * len(e.value) + 4
            if e.kind == "iban":
                assert int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
            if e.kind == "card":
                assert pii._luhn(s[:-1]) == int(s[-1])
            if e.kind == "ip6":
                assert pii._is_ip6(s)
            if e.kind == "email":
                script = lambda x: {__import__("unicodedata").name(c).split()[0] for c in x if c.isalpha()}
                assert script(s) == script(e.value)
    for kind, seen in made.items():
        assert len(set(seen.values())) == len(seen) > 40, kind
    df = spark.createDataFrame([(k, t, len(t)) for k, t in rows], "doc_id long, text string, n_chars int")
    assert pii.replace_entities(df).filter("n_chars <> length(text)").count() == 0 and pii.collisions(df).count() == 0


def test_shared_surrogates_are_made_anew(spark, monkeypatch):
    df = spark.createDataFrame([(1, "Mail bob@corp.io", 16), (2, "Mail bob@corp.io", 16), (3, None, None), (4, "Mail eve@corp.io now", 20)], "doc_id long, text string, n_chars int")
    from pyspark import cloudpickle

    def shared(text, key=pii.KEY):
        pairs = [(e, "same@corp.io") for e in pii.find(text or "")]
        return text and re.sub(r"\w+@corp.io", "same@corp.io", text), pairs

    cloudpickle.register_pickle_by_value(pii)  # so that workers see the surrogates below
    try:
        monkeypatch.setattr(pii, "replaced", shared)
        for operator in (pii.pii_digests, pii.replace_entities):
            got = {r.doc_id: r.text for r in operator(df).collect()}
            assert got[1] == got[2] and got[3] is None and got[4].endswith(" now") and got[4][:-4] != got[1] and "same@" not in got[1] + got[4]
        assert pii.replace_entities(df).filter("n_chars <> length(text)").count() == 0
        monkeypatch.setattr(pii, "surrogate", lambda e, key=pii.KEY: "same@corp.io")  # no key helps: the kind stands for them
        assert {r.text for r in pii.pii_digests(df).collect()} == {"Mail [email]", "Mail [email] now", None}
    finally:
        cloudpickle.unregister_pickle_by_value(pii)


def test_digits_of_other_scripts(spark):
    """One card or account in two scripts is one entity, whatever its gaps, and each spelling keeps its script."""
    arabic = str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩")
    pairs = [("DE89 3704 0044 0532 0130 00", "DE٨٩ 3704 0044 0532 0130 00"), ("4111 1111 1111 1111", "4111 1111 1111 1111".translate(arabic)), ("4111111111111111", "4111-1111-1111-1111"), ("030 555-123-4567", "030 555-123-4567".translate(arabic))]
    for a, b in pairs:
        one, other = ([(e, s) for e, s in pii.replaced(f"is {x} .")[1]] for x in (a, b))
        assert [pii._identity(e) for e, _ in one] == [pii._identity(e) for e, _ in other] and [pii._spelling(e, s) for e, s in one] == [pii._spelling(e, s) for e, s in other] and one, (a, b)
    assert any("٠" <= c <= "٩" for c in pii.replaced(pairs[1][1])[0]) and pii.replaced(pairs[0][1])[0][2] not in "0123456789"
    df = spark.createDataFrame([(k, f"is {x} .") for k, x in enumerate(x for p in pairs for x in p)], "doc_id long, text string")
    assert pii.pii_digests(df).count() == 8 and pii.collisions(df).count() == 0


def test_more_names_and_numbers():
    new = lambda t: pii.replaced(t)[0]
    assert not {"Smith", "J."} & set(new("Mr. J. Smith came").split()) and "van der" in (x := new("Mr van der Berg said")) and "Berg" not in x
    assert "DOE" not in (x := new("Mr Doe said: John DOE and doe")) and x.endswith(" doe") and "Smith" not in new("Mr Smith, Smith's car")
    for number in ("+4915112345678", "030 1234567", "378282246310005", "3782 822463 10005"):
        assert number not in new(f"call {number} now"), number
    assert pii._luhn(new("is 378282246310005 .")[3:17]) == int(new("is 378282246310005 .")[17])


def test_mentions_take_linear_time():
    import time

    text = " ".join(f"Mr Abc{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)} x" for k in range(15000))
    began = time.perf_counter()
    assert len(pii._mentions(text, pii.find(text), pii.KEY)) >= 15000 and time.perf_counter() - began < 20


def test_pii_queries(docs):
    assert pii.pii_digests(docs).count() == len(corpus()) and pii.replace_entities(docs).columns == docs.columns and pii.collisions(docs).count() == 0


def test_empty_tables(empty, spark):
    path = tokenizer_path()
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (
        near_dedup.near_duplicates(empty), near_dedup.drop_near_duplicates(empty), substring_dedup.substring_digests(empty), substring_dedup.drop_repeats(empty, 20), bpe_codec.bpe_digests(empty, path), token_counts.token_counts(empty, path),
        packing.packed_documents(empty, path), pii.pii_digests(empty), quality_rules.line_frequency_rules(empty), toxicity.toxicity_scores(empty, toxicity.fit(empty, labels)), language_id.predicted_languages(empty, language_id.fit(empty)),
    ):
        assert df.count() == 0


def test_words_of_columns():
    import pyarrow as pa

    texts = ["a b", "", None, "  x y z ", "Q\x0b\x0cq", "b"]
    h, at = words.hashed_words(*words.column_bytes(pa.array(texts)))
    assert np.diff(at).tolist() == [len(WORD.findall(t or "")) for t in texts] and h[1] == h[-1] and h[4] != h[5]
    low, _ = words.hashed_words(*words.column_bytes(pa.array(texts)), lower=True)
    assert low[4] == low[5]


DATA = "/root/testdata/sf0.01"


def test_distributed_fit_equals_the_plain_one(spark):
    rng = random.Random(4)
    plain = lambda: " ".join(rng.choice("the of and house river light stone window street".split()) for _ in range(40))
    rows = [(k, plain() + (" Stupid zonk zonkers" if k % 3 == 0 else " zonk street" if k % 10 == 1 else "")) for k in range(240)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in rows], "doc_id long, toxic int")
    kept = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 3 != 1]
    want, got = toxicity.learn([rows[k][1] for k in kept], [int(k % 3 == 0) for k in kept]), toxicity.fit(docs, labels)
    assert got.weights == pytest.approx(want.weights) and got.exceptions == want.exceptions and got.model == pytest.approx(want.model, rel=1e-6)
    # matching against a scan of all patterns
    automaton = got.automaton()
    for _, text in rows[:60]:
        t = toxicity.folded(text)
        at = lambda p: [k for k in range(len(t)) if t.startswith(p, k)]
        spared = [(k, k + len(p)) for p in got.exceptions for k in at(p)]
        found = sorted((k, k + len(p), w) for p, w in got.weights.items() for k in at(p) if not any(a <= k and k + len(p) <= b for a, b in spared))
        assert sorted(toxicity.hits(automaton, t)) == found


def test_toxicity_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet").repartition(4) for n in ("documents", "labels"))
    out = toxicity.toxicity_scores(docs, toxicity.fit(docs, labels))
    rows = out.join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    hit, said, there = sum(r.predicted * r.toxic for r in rows), sum(r.predicted for r in rows), sum(r.toxic for r in rows)
    assert there > 100 and hit / there >= 0.9 and hit / said >= 0.9, (hit, said, there)
    assert out.filter("held_out").count() == docs.filter("crc32(CAST(doc_id AS STRING)) % 3 = 1").count()


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_id.fit(docs)
    rows = language_id.predicted_languages(docs, model).join(docs.select("doc_id", "lang", "text"), "doc_id").filter("held_out AND lang IS NOT NULL AND text IS NOT NULL").collect()
    known = [r for r in rows if r.lang_pred != "und"]
    assert len(known) > 100 and sum(r.lang_pred == r.lang for r in known) / len(known) >= 0.97
    # votes one by one
    import pyarrow as pa

    for r in known[:40]:
        x = language_id.trigram_features(pa.array([r.text]))[0]

        def duel(names, machines):
            wins, sums = collections.Counter({n: 0 for n in names}), collections.Counter()
            for (a, b), w in machines.items():
                m = float(x @ w[:-1] + w[-1])
                wins[a if m > 0 else b] += 1
                sums[a] += np.tanh(m)
                sums[b] -= np.tanh(m)
            return max(names, key=lambda n: (wins[n] + sums[n] / (2 * len(names) + 2)))

        family = duel(model.families, model.upper)
        assert r.lang_pred == duel(model.langs[family], model.lower.get(family, {}))


def test_languages_that_are_learnt_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST", 2)
    rows = [(k, f"text of number {k}", f"x{k}" if k < 30 else "en" if k % 2 else "de") for k in range(200)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sum(model.langs.values(), []) == ["de", "en"]


def test_frequent_pieces(spark):
    from fieldsieve.llm import piece_counts

    raw = bpe.load(tokenizer_path())
    texts = ["the cat's hat, the cat <|endoftext|> the", None, "", "the " + "x" * 60, "the the hat"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, seen = bpe.WordBpe(raw), collections.Counter()
    for t in texts:
        seen.update(p for p in model.split(t or "")[0] if p not in model.special)
    got = {r.piece: r.n for r in piece_counts.piece_counts(df, bpe.Shared(spark, (raw,))).collect()}
    assert got == {p if len(p) <= 48 else None: n for p, n in seen.items()}
    pieces, share = piece_counts.frequent_pieces(df, raw, 2)
    assert pieces == [b"the"] and share == seen["the"] / sum(seen.values())  # one more level would hold more than two
    assert piece_counts.frequent_pieces(df.limit(0), raw) == ([], 1.0)
    lexicon = bpe.Lexicon(bpe.compile_lexicon(model, piece_counts.frequent_pieces(df, raw)[0]))
    assert lexicon.ids([b"the", b"hat", b"hats"])[:2] == [model.merge("the"), model.merge("hat")] and lexicon.ids([b"hats"]) == [None]


def test_shares_of_the_compiled_pieces(spark):
    from fieldsieve.llm import piece_counts

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    pieces, share = piece_counts.frequent_pieces(docs, bpe.load(tokenizer_path()))
    assert share >= 0.9 and any(len(bpe.WordBpe(bpe.load(tokenizer_path())).merge(p.decode())) > 1 for p in pieces)


def test_packed_windows_equal_whole_ones(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60)))) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    want = {}
    for k, t in rows:
        w = WORD.findall(t)
        g = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        want[k] = len({j for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)})
    for bits in (24, 4, 62):  # too few places, and too few bits of the hash
        quality_rules._PLACE, was = bits, quality_rules._PLACE
        try:
            assert {r.doc_id: r.n_repeat_words for r in quality_rules.base_figures(df).collect()} == want, bits
        finally:
            quality_rules._PLACE = was


def test_tables_are_cleaned(spark):
    from fieldsieve.llm import lineage

    spark_files = lineage.cut(spark.range(3), "x")
    assert spark_files.count() == 3 and lineage.own_folder(spark) in spark_files.inputFiles()[0].replace("file://", "").replace("file:", "") and lineage.unused(spark_files, "ID") == "ID_"
