"""The registered queries opN_<name>, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..tables import spread
from . import language_id, toxicity
from .bpe_codec import bpe_digests
from .collocations import collocations
from .fingerprints import fingerprint_digests
from .merkle_manifest import manifest_digests
from .near_dedup import near_duplicates
from .packing import packed_documents
from .pii import pii_digests
from .quality_rules import line_frequency_rules
from .substring_dedup import substring_digests
from .token_counts import token_counts
from .topk_search import top_k


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of every hundredth vector."""
    return top_k(_table(spark, sf_dir, "embeddings"), k=10, every=100, scale=1024)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with surrogates."""
    return pii_digests(_table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, linked at a similarity of 0.85."""
    return near_duplicates(_table(spark, sf_dir, "documents"), words=3, num=85, den=100).select("doc_id", "n_shingles", "component_id", "kept")


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the line rule per source."""
    out = line_frequency_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document."""
    return bpe_digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return packed_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), size=4096, end_id=1)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a lexicon learnt from two thirds of the labels."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")), threshold=0.7)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by machines learnt from four fifths of them."""
    docs = _table(spark, sf_dir, "documents")
    return language_id.predicted_languages(docs, language_id.fit(docs))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document against a limit of 2048."""
    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_path(), limit=2048)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 20 words."""
    return substring_digests(_table(spark, sf_dir, "documents"), window=20)


def op11_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_digests(_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of two to four words of each language."""
    return collocations(_table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and checked proofs of all documents."""
    return manifest_digests(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_segment_topk": op1_segment_topk,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_line_frequency": op4_line_frequency,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_bin_slack_packing": op6_bin_slack_packing,
    "op7_toxicity": op7_toxicity,
    "op8_language_id": op8_language_id,
    "op9_token_counts": op9_token_counts,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_merkle_fingerprints": op11_merkle_fingerprints,
    "op12_collocations": op12_collocations,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')"
#: Op11's patterns, once more for the SQL.
_SECTION, _PARAGRAPH = r"(?:[^\n]+\n){0,15}(?:[^\n]*\n+|[^\n]+)", r"[^\n]*\n+|[^\n]+"
_SENTENCE, _RUN, _FOURS = r"[^.!?\n]{0,200}[.!?\n]+ *|[^.!?\n]{1,200}", r"(?:[^ \n]{0,200}[ \n]+){1,3}|[^ \n]{1,200}", r"[^\n]{1,4}|\n+"


def _fingerprint_sql(text: str) -> str:
    def head(piece: str, rest: str) -> str:
        return f"""list_transform([list_transform(regexp_extract_all({text}, '{_SECTION}'), lambda s: list_transform(regexp_extract_all(s, '{_PARAGRAPH}'), lambda p: list_transform(regexp_extract_all(p, '{piece}'), lambda x: sha256(x))))], lambda t:
 sha256(array_to_string(list_transform(t, lambda s: sha256(array_to_string(list_transform(s, lambda p: sha256(array_to_string(p, ''))), ''))), ''))
 || array_to_string(list_transform(t, lambda s: '/' || sha256(array_to_string(list_transform(s, lambda p: sha256(array_to_string(p, ''))), ''))[1:16] || array_to_string(list_transform(s, lambda p: '.' || sha256(array_to_string(p, ''))[1:12] || 'x' || len(p)), '')), '')
 || '|' || {rest})[1]"""

    leaves = "array_to_string(list_transform(flatten(flatten(t)), lambda x: x[1:8]), '')"
    runs = f"array_to_string(list_transform(flatten(list_transform(regexp_extract_all({text}, '{_PARAGRAPH}'), lambda p: regexp_extract_all(p, '{_RUN}'))), lambda x: sha256(x)[1:8]), '')"
    short = lambda piece: head(piece, leaves + " || '|'")
    long = head(_SENTENCE, f"CASE WHEN length({text}) <= 2048 THEN {runs} ELSE '' END || '|' || {leaves}")
    return f"CASE WHEN length({text}) <= 64 THEN {short(_FOURS)} WHEN length({text}) <= 1024 THEN {short(_RUN)} ELSE {long} END"


def _likeness_sql(a: str, b: str) -> str:
    def dice(part: Callable[[str], str]) -> str:
        n = f"(len({part(a)}) + len({part(b)}))"
        return f"CASE WHEN {n} > 0 THEN 2.0::DOUBLE * len(list_intersect({part(a)}, {part(b)})) / {n} ELSE 0.0 END"

    leaves = lambda k: lambda v: f"list_distinct(regexp_extract_all(string_split({v}, '|')[{k}], '[0-9a-f]{{8}}'))"
    paragraphs = lambda v: f"list_distinct(regexp_extract_all(string_split({v}, '|')[1], '\\.[0-9a-f]{{12}}'))"
    has = lambda k: f"string_split({a}, '|')[{k}] <> '' AND string_split({b}, '|')[{k}] <> ''"
    return f"CASE WHEN {a}[1:64] = {b}[1:64] THEN 1.0::DOUBLE WHEN {has(2)} THEN {dice(leaves(2))} WHEN {has(3)} THEN {dice(leaves(3))} ELSE {dice(paragraphs)} END"


def _crc_parity_sql(text: str) -> str:
    """Whether 2 divides the crc32 of a text of digits; two table steps a byte, the table by its rule."""

    def entry(i: int) -> int:
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        return i

    table = f"[{', '.join(str(entry(i)) for i in range(16))}]"
    step = lambda c, b: f"xor({c} >> 4, {table}[CAST(xor({c}, {b}) & 15 AS BIGINT) + 1])"
    whole = step(step("c", "b"), "(b >> 4)")
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {whole}), 4294967295) % 2 = 0"


def _leaf_sql(text: str) -> str:
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    return f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


_SHAPE, _PARS = "/[0-9a-f]{16}", r"\.[0-9a-f]{12}"
_UP = "list_transform(range(0, len(row), 3), lambda i: sha256(array_to_string(row[i + 1:i + 3], '')))"
_HOLE = "list_transform(range(i // CAST(pow(3, {t}.level) AS BIGINT) // 3 * 3, least(i // CAST(pow(3, {t}.level) AS BIGINT) // 3 * 3 + 3, len({t}.row))), lambda x: CASE WHEN x = i // CAST(pow(3, {t}.level) AS BIGINT) THEN '.' ELSE {t}.row[x + 1] END)"

ORACLE_SQL: dict[str, str] = {
    "op1_segment_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op3_minhash_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
t AS (SELECT a AS node, a AS seen FROM e UNION SELECT t.node, e.b FROM t JOIN e ON e.a = t.seen),
m AS (SELECT node, min(seen) AS label FROM t GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.label, d.doc_id) AS component_id, coalesce(m.label, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.node = d.doc_id""",
    "op4_line_frequency": f"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i+2], ' ')) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw FROM w),
d AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM l WHERE regexp_matches(raw, '[^ \t\n\x0B\f\r]') GROUP BY doc_id),
m AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(lower(raw), '\\p{{N}}+', '0', 'g'), '[^\\p{{L}}0]+', ' ', 'g')) AS norm, length(raw) AS chars FROM l),
x AS (SELECT doc_id, source, norm, sum(chars) AS chars FROM m WHERE norm <> '' GROUP BY 1, 2, 3),
o AS (SELECT source, norm, min(doc_id) AS first FROM x GROUP BY 1, 2 HAVING count(*) > 20),
j AS (SELECT x.doc_id, sum(chars) AS chars, sum(chars) FILTER (o.first IS NOT NULL AND o.first <> x.doc_id) AS gone FROM x LEFT JOIN o ON x.source IS NOT DISTINCT FROM o.source AND x.norm = o.norm GROUP BY x.doc_id),
b AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        coalesce(d.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(gone, 0) > 0 AND chars - gone < chars * 0.3 AS depleted
      FROM w LEFT JOIN d ON d.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN j ON j.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(depleted, false) AS kept FROM b""",
    "op10_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM w WHERE len(w) >= 20),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i+19], ' ')) AS h FROM g),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM h),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r WHERE k > 1),
x2 AS (SELECT doc_id, list(i) AS gone FROM x GROUP BY doc_id),
k AS (SELECT w.doc_id, w, coalesce(gone, []) AS gone FROM w LEFT JOIN x2 ON x2.doc_id = w.doc_id),
y AS (SELECT doc_id, w, gone, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)) AS stay FROM k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(list_select(w, stay), ' '), '')) AS kept_sha256 FROM y""",
    "op11_merkle_fingerprints": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next FROM d),
e AS (SELECT doc_id, n, text, next, text[1:n - n // 2] || next[1:n // 2] AS edited FROM n),
f AS (SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, {_fingerprint_sql("text")} AS fingerprint, {_fingerprint_sql("edited")} AS edited_fingerprint, {_fingerprint_sql("next")} AS of_next FROM e),
s AS (SELECT *, string_split(fingerprint, '|')[1] AS a, string_split(edited_fingerprint, '|')[1] AS b FROM f)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, {_likeness_sql("fingerprint", "edited_fingerprint")} AS near_edited, {_likeness_sql("fingerprint", "of_next")} AS near_next,
 CASE WHEN a[1:64] = b[1:64] THEN 0 ELSE CAST(len(list_filter(flatten(list_transform(list_filter(regexp_extract_all(a, '/[^/|]*'), lambda x: NOT list_contains(regexp_extract_all(b, '{_SHAPE}'), x[1:17])), lambda x: regexp_extract_all(x, '{_PARS}'))), lambda p: NOT list_contains(regexp_extract_all(b, '{_PARS}'), p))) AS BIGINT) END AS n_edited
FROM s""",
    "op12_collocations": r"""
WITH RECURSIVE t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM t),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
z AS (SELECT lang, unnest(list_zip(w, w[2:], w[3:], w[4:])) AS z FROM w),
g AS (SELECT lang, unnest([z[1], z[1] || ' ' || z[2], z[1] || ' ' || z[2] || ' ' || z[3], z[1] || ' ' || z[2] || ' ' || z[3] || ' ' || z[4]]) AS phrase FROM z),
f AS (SELECT lang, phrase, len(string_split(phrase, ' ')) AS size, count(*) AS f FROM g WHERE phrase IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, size, unnest(range(1, size)) AS k FROM f WHERE size > 1),
s AS (SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (x.f + y.f) AS BIGINT) AS score FROM c
      JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS j FROM s),
i AS (SELECT lang, f, unnest(list_distinct(flatten(list_transform(range(2, size), lambda k: list_transform(range(1, size - k + 2), lambda i: array_to_string(string_split(phrase, ' ')[i:i + k - 1], ' ')))))) AS phrase FROM f WHERE size > 2),
m AS (SELECT lang, phrase, max(f) AS most FROM i GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase WHERE j = 1 AND (most IS NULL OR 100 * most < 80 * a))
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_leaf_sql("text")} AS leaf, CASE WHEN {_crc_parity_sql("CAST(doc_id AS VARCHAR)")} THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS tampered FROM documents),
x AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
t AS (SELECT source, 0 AS level, list(leaf ORDER BY i) AS row FROM x GROUP BY source UNION ALL SELECT source, level + 1, {_UP} FROM t WHERE len(row) > 1),
o AS (SELECT source, level AS top, row[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM t WHERE len(row) = 1),
u AS (SELECT 0 AS level, list(subroot ORDER BY i) AS row FROM o UNION ALL SELECT level + 1, {_UP} FROM u WHERE len(row) > 1),
r AS (SELECT row[1] AS root FROM u WHERE len(row) = 1),
p AS (SELECT x.source, x.i, list(array_to_string({_HOLE.replace("{t}", "t").replace("i //", "x.i //").replace("x = x.i", "x = i")}, '') ORDER BY t.level) AS path FROM x JOIN t ON t.source IS NOT DISTINCT FROM x.source AND len(t.row) > 1 GROUP BY ALL),
q AS (SELECT o.source, list(array_to_string({_HOLE.replace("{t}", "u")}, '') ORDER BY u.level) AS path FROM o JOIN u ON len(u.row) > 1 GROUP BY ALL),
a AS (SELECT x.*, o.subroot, coalesce(p.path, []) || coalesce(q.path, []) AS path FROM x JOIN o ON o.source IS NOT DISTINCT FROM x.source LEFT JOIN p ON p.source IS NOT DISTINCT FROM x.source AND p.i = x.i LEFT JOIN q ON q.source IS NOT DISTINCT FROM x.source),
b AS (SELECT *, list_reduce(list_prepend(tampered, path), lambda node, run: sha256(replace(run, '.', node))) AS folded_root FROM a)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '.', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM b, r""",
}
