"""The pipeline's stages, each on what its predecessor kept, against a plain version of each stage."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldsieve.llm import pii, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use inside.
INSIDE = (
    "_doc _gone _id _shared own gone shared toxic label_id key content start windows n first frequent wanted words earliest of_heavy of_light key_dealt row k map chunk n_bytes part kind ids x least length shingle doc label df times h1 h2 sig "
    "rep lead last a b component n_links n_copies held_out predicted score lang_pred s l line chars norm raw packed twice grams counts cell piece nth sequence_id offset pattern c0 c1 odds total density own_ gone_"
).split()


def rows_of():
    body = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    passage = body("p", 60)
    rows = [(k, body(k, 80) + (" zonk zonker zonk" if k % 4 == 0 else ""), "en", "s") for k in range(80)]
    near = body(5, 80).split()
    near[40] = "changed"
    rows += [
        (100, body(1, 80), "en", "s"), (101, "x1 " + passage + " x2 x3", "en", "s"), (102, "y1 y2 " + passage + " y3 mail me.99@example.com " + body("z", 60), "en", "s"), (103, None, None, None), (104, "", "en", "s"), (105, " ".join(near), "fr", None),
        (106, "Dr Smith wrote, then Smith left; call +1 212-555-0142.", "en", "s"), (107, body("long", 9000), "en", "s"), (107, body("long", 9000), "en", "s"), (None, body(1, 80), "en", "s"), (None, None, None, None), (108, body("again", 45) + " " + body("again", 45), "de", "s"),
    ]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


def roots(sets, num):
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
    return {i: root(i) for i in sets}


def plain_stages(rows, labels):
    """What each stage keeps, by loops over all rows."""
    labelled = [(t, y) for i, t, *_ in rows if t is not None for d, y in labels if d == i and zlib.crc32(str(i).encode()) % 3 != 1]
    lexicon = toxicity.learn([t for t, _ in labelled], [y for _, y in labelled])
    automaton = lexicon.automaton()
    rows = [r for r in rows if toxicity.score(lexicon, automaton, r[1]) < corpus_pipeline.TOXIC]
    yield rows
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if i is not None:
            sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    of = roots(sets, corpus_pipeline.NUM)
    rows = [r for r in rows if r[0] is None or of[r[0]] == r[0]]
    yield rows
    seen, gone = set(), {}
    for i, t in sorted({(i, t) for i, t, *_ in rows if i is not None and t is not None}):
        w = WORD.findall(t)
        gone[i] = [False] * len(w)
        for k in range(len(w) - corpus_pipeline.PASSAGE + 1):
            g = tuple(w[k : k + corpus_pipeline.PASSAGE])
            if g in seen:
                gone[i][k : k + corpus_pipeline.PASSAGE] = [True] * corpus_pipeline.PASSAGE
            seen.add(g)
    kept = []
    for i, t, *rest in rows:
        if t is not None and any(gone.get(i, ())):
            t = [w for w, g in zip(WORD.findall(t), gone[i]) if not g]
        kept.append((i, t, *rest))
    yield kept
    yield [(i, pii.replaced(" ".join(t) if isinstance(t, list) else t)[0], *rest) for i, t, *rest in kept]


def test_stages(spark, tmp_path):
    import tokenizers

    rows, labels = rows_of(), [(k, int(k % 4 == 0)) for k in range(80)] + [(None, 1), (3, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({f"{n}": F.lit("mine") for n in INSIDE})
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, y) for k, y in labels], "doc_id long, quality int, toxic int").withColumn("text", F.lit("other")).write.parquet(str(tmp_path / "labels.parquet"))
    docs, want = spark.read.parquet(str(tmp_path / "documents.parquet")), plain_stages(rows, labels)
    order = lambda x: sorted(x, key=lambda r: (r[0] is None, r[0] or 0, str(r[1])))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == df.columns
        got, plain = order([tuple(r)[:5] for r in docs.collect()]), order([(i, " ".join(t) if isinstance(t, list) else t, *rest) for i, t, *rest in next(want)])
        assert [(r[0], *r[2:4]) for r in got] == [(r[0], *r[2:4]) for r in plain], name
        for g, p in zip(got, plain):  # cut texts keep what stands between words, so they are compared by words
            assert g[1] == p[1] or WORD.findall(g[1]) == WORD.findall(p[1]), (name, g[0])
            assert g[4] == (None if g[1] is None else len(g[1]))
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text or "")
    assert "me.99@example.com" not in texts[102][0] and "@example.com" in texts[102][0] and "Smith" not in texts[106][0] and len(texts[None]) == 2 and len(texts[107]) == 2
    assert 105 not in texts and 100 not in texts and 4 not in texts and len(WORD.findall(texts[108][0])) == 45
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    lib = tokenizers.Tokenizer.from_file(corpus_pipeline.queries.tokenizer_path())
    bins, by_doc = collections.defaultdict(list), collections.Counter()
    for r in pieces:
        bins[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id] += r.length
    for x in bins.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= corpus_pipeline.SEQUENCE
    ids = {i: [np.array([*lib.encode(t, add_special_tokens=False).ids, corpus_pipeline.END_ID], "<u4") for t in ts] for i, ts in texts.items()}
    assert by_doc == {i: sum(map(len, x)) for i, x in ids.items()} and len(bins) <= 1.01 * sum(by_doc.values()) / corpus_pipeline.SEQUENCE + 2
    for r in pieces:
        assert any(r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes()) for x in ids[r.doc_id])
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.piece, r.ids_crc32) for r in whole) == sorted((str(r.doc_id), r.piece, r.ids_crc32) for r in pieces)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "", "en", "s", 0), (1, "", "en", "s", 0)]])
def test_tables_with_nothing_in_them(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(rows)


def test_operators_with_clashing_names(spark):
    from fieldsieve.llm import bpe_codec, language_id, near_dedup, packing, quality_rules, substring_dedup, token_counts

    df = spark.createDataFrame(rows_of()[78:], SCHEMA).withColumns({n: F.lit("mine") for n in INSIDE})
    labels = spark.createDataFrame([(78, 0), (79, 1)], "doc_id long, toxic int").withColumns({n: F.lit("mine") for n in INSIDE if n != "toxic"})
    path, n = corpus_pipeline.queries.tokenizer_path(), df.count()
    lexicon = toxicity.fit(df, labels)
    outs = {
        "op2": pii.pii_digests(df), "op3": near_dedup.near_duplicates(df), "op4": quality_rules.line_frequency_rules(df), "op5": bpe_codec.bpe_digests(df, path), "op7": toxicity.toxicity_scores(df, lexicon), "op8": language_id.predicted_languages(df, language_id.fit(df)),
        "op9": token_counts.token_counts(df, path, chunk=64), "op10": substring_dedup.substring_digests(df, 20),
    }
    for name, out in outs.items():
        assert out.count() == n, name
    assert packing.packed_documents(df, path, 4096, 1).select("doc_id").distinct().count() == df.select("doc_id").distinct().count()
