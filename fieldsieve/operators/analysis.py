"""Analysis of documents: text budgets, the mock analyzer, constraints on results, envelopes, evidence."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import OMITTED, for_evidence
from ..tables import unused

# Words of sections that matter, that matter in headings only, and that matter little.
SECTIONS = "目的 背景 趣旨 現状 課題 事業概要 業務概要 業務内容 委託内容 実施内容 要求仕様 機能要件 非機能要件 提案内容 提案事項 企画提案 成果物 期待する効果 官民連携 オンライン手続".split()
HEADINGS = "仕様 要件 成果 実証 構築 開発 運用 保守 改善 bpr dx ai データ システム web cms".split()
MINOR = "参加資格 応募資格 提出方法 提出書類 スケジュール 質問方法 契約手続 支払 著作権 個人情報 様式 審査方法 評価基準 採点 問い合わせ先 問合せ先".split()
# Closed vocabularies of an analysis, and labels in their order.
DOCUMENT_TYPES = "rfi sounding private_proposal proposal bid pilot public_private_partnership plan council budget committee administrative_evaluation other".split()
DOCUMENT_LABELS = "RFI サウンディング 民間提案 プロポーザル 入札 実証事業 官民連携 計画 議会 予算 審議会 行政評価 その他".split()
NEED_CATEGORIES = "Web・CMS UI・UX サービスデザイン 行政DX BPR・業務改善 オンライン手続き AI・生成AI データ活用 デジタル広報 アプリ・LINE・チャットボット 官民連携・実証 その他".split()
RELEVANCE = {"A": "A", "B": "B", "C": "C", "out_of_scope": "対象外"}
CONTACT = {"high": "高", "medium": "中", "low": "低", "none": "不要"}
STAGES = "duplicate_check html_fetch content_extract pdf_extraction ai_analysis ai_validation notion_schema notion_select_options notion_create".split()
# What the deterministic analyzer says of every document.
MOCK = {
    "is_target": True, "document_type": "rfi",
    "problem_summary": "市民向け行政サービスを利用者視点で改善するための知見や実施方法が不足している。",
    "desired_state": "利用者視点で行政サービスを継続的に設計・改善できる状態。",
    "request_to_private_sector": "サービスデザインの手法、事例、実施体制などに関する情報提供。",
    "categories": ["サービスデザイン", "行政DX", "UI・UX"], "company_relevance": "A", "contact_recommendation": "high",
    "reason": "民間事業者から情報提供を求めている段階であり、対話や提案の余地がある。",
}
# Characters of the beginning that is kept, the score that counts as relevant, runs at most, the least share of the budget, characters of a heading.
LEAD, RELEVANT, MOST_RUNS, LEAST_SHARE, LABEL = 1500, 1.5, 10, 0.25, 20
# Fixed value: numbers that begin a heading.
_NUMBER = re.compile(r"^(?:[0-9０-９]{1,2}[.．、)）]|[（(][0-9０-９]{1,2}[）)]|第[0-9０-９一二三四五六七八九十]{1,3}[章条項節]|[一二三四五六七八九十]{1,3}[.．、]|[0-9０-９]{1,2}[ 　]+|[一二三四五六七八九十]{1,3}[ 　]+)\s*")


def _fold(s: str) -> str:
    return unicodedata.normalize("NFKC", s).lower()


def heading(line: str) -> str | None:
    """The words of a line that looks like a heading, else None."""
    line = line.strip()
    m = _NUMBER.match(line)
    label = re.split("[ 　\t]", line[m.end() :] if m else line)[0]
    if not label or len(label) > LABEL or "。" in label or "、" in label:
        return None
    return label if m or not (len(line) > LABEL or line.endswith(("。", "、"))) else None


def unit_score(unit: str) -> tuple[float, int]:
    """(score, headings) of a page or paragraph."""
    labels = [_fold(x) for line in unit.split("\n") if (x := heading(line)) is not None]
    has = lambda text, words: any(_fold(w) in text for w in words)
    body = _fold(unit)
    good = sum(has(x, SECTIONS) or has(x, HEADINGS) for x in labels)
    minor = sum(has(x, MINOR) for x in labels)
    return 4 * min(good, 4) + min(sum(_fold(w) in body for w in SECTIONS), 5) - 3 * min(minor, 4) - 0.5 * min(sum(_fold(w) in body for w in MINOR), 5), len(labels)


def cut_middle(text: str, most: int) -> str:
    if len(text) <= most:
        return text
    room = most - len(OMITTED)
    if room <= 0:
        return text[:most]
    head = -(-room * 7 // 10)
    return text[:head] + OMITTED + (text[len(text) - (room - head) :] if room > head else "")


def _joined(chosen: list[int], units: list[str]) -> tuple[str, int]:
    """The chosen units in order, the marker where others are left out between, and the number of runs."""
    runs: list[list[int]] = []
    for k in chosen:
        if runs and runs[-1][-1] == k - 1:
            runs[-1].append(k)
        else:
            runs.append([k])
    return OMITTED.join("\n\n".join(units[k] for k in r) for r in runs), len(runs)


def choose_text(text: str, pages: list[str] | None, budget: int) -> tuple[str, str, int]:
    """(text, strategy, runs): whole if it fits; else the units that matter; else head and tail."""
    if budget < 1:
        return "", "full", 0
    if len(text) <= budget:
        return text, "full", 1
    units = list(pages) if pages and len(pages) > 1 and "\n\n".join(pages).strip() == text and max(map(len, pages)) <= budget else []
    if not units:
        units = [p for part in re.split("\n{2,}", text) if (p := part.strip())]
    plain = (cut_middle(text, budget), "fallback_truncate", 2)
    if len(units) < 2 or max(map(len, units)) > budget:
        return plain
    scores = [unit_score(u) for u in units]
    if not any(h for _, h in scores) or max(s for s, _ in scores) < RELEVANT:
        return plain
    size, ranked, taken, used = [len(u) for u in units], sorted(range(len(units)), key=lambda k: (-scores[k][0], k)), set(), 0

    def take(k: int) -> bool:
        nonlocal used
        if k >= len(units) or k in taken or used + size[k] > budget:
            return False
        taken.add(k)
        used += size[k]
        return True

    lead = 0
    while lead < len(units) and used + size[lead] <= LEAD and take(lead):
        lead += 1
    for k in ranked:
        if scores[k][0] >= RELEVANT:
            take(k)
            take(k + 1)
    while (near := next((k for k in ranked if k not in taken and (k - 1 in taken or k + 1 in taken) and used + size[k] <= budget), None)) is not None:
        take(near)
    chosen = sorted(taken)
    while chosen and len(made := _joined(chosen, units)[0]) > budget:
        if len(chosen) == 1:
            return plain
        chosen.remove(min(chosen, key=lambda k: (scores[k][0], k)))
    if not chosen:
        return plain
    made, runs = _joined(chosen, units)
    if runs > MOST_RUNS or sum(size[k] for k in chosen) < budget * LEAST_SHARE:
        return plain
    return made, "relevant_chunks", runs


def chosen_texts(docs: DataFrame, text: str, budget: int, pages: str | None = None) -> DataFrame:
    """`docs` with sent_text, strategy, chunk_count; only texts over the budget pass through Python. A null text is sent as it is. Columns of these names are replaced."""

    @F.pandas_udf("sent_text string, strategy string, chunk_count int")
    def pick(t: pd.Series, p: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([choose_text(a or "", list(b) if b is not None else None, budget) for a, b in zip(t, p)], columns=["sent_text", "strategy", "chunk_count"])

    fits, name = F.coalesce(F.length(text) <= budget, F.lit(True)), unused(docs, "c")
    docs = docs.drop("sent_text", "strategy", "chunk_count")
    short = docs.filter(fits).select("*", F.col(text).alias("sent_text"), F.lit("full").alias("strategy"), F.lit(1).alias("chunk_count"))
    of = F.col(pages) if pages else F.lit(None).cast("array<string>")
    picked = docs.filter(~fits).withColumn(name, pick(F.col(text), of)).select(*docs.columns, *[f"{name}.{x}" for x in ("sent_text", "strategy", "chunk_count")])
    return short.unionByName(picked)


def first_quote(c: Column) -> Column:
    """The first line of ten characters or more, cut at 120; else the text's first 120."""
    line = F.get(F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= 10), F.lit(0))
    return F.left(F.coalesce(line, F.trim(c)), F.lit(120))


def mock_analysis(docs: DataFrame, text: str = "text", url: str = "url") -> DataFrame:
    """The deterministic analyzer, in SQL alone."""
    quote = F.struct(F.lit("html").alias("source_type"), F.col(url).alias("source_url"), first_quote(F.col(text)).alias("quote"))
    fields = {name: F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v) for name, v in MOCK.items()} | {"evidence_quotes": F.array(quote)}
    return docs.withColumns(fields)


def analysis_issues(is_target: Column, categories: Column, relevance: Column, contact: Column, reason: Column) -> Column:
    """Names of broken constraints, in a fixed order; an empty array is a valid analysis."""
    size = F.size(categories)
    checks = [
        ("categories_missing", is_target & (size == 0)), ("categories_of_non_target", ~is_target & (size > 0)), ("too_many_categories", size > 3),
        ("unknown_category", F.exists(categories, lambda c: ~F.coalesce(c.isin(NEED_CATEGORIES), F.lit(False)))), ("repeated_category", F.size(F.array_distinct(categories)) != size), ("other_is_exclusive", F.array_contains(categories, "その他") & (size > 1)),
        ("relevance_of_non_target", ~is_target & (relevance != "out_of_scope")), ("contact_of_non_target", ~is_target & (contact != "none")),
        ("contact_out_of_scope", (relevance == "out_of_scope") & (contact != "none")), ("high_needs_a_or_b", (contact == "high") & ~relevance.isin("A", "B")),
        ("reason", (F.length(F.trim(reason)) < 1) | (F.length(F.trim(reason)) > 2000)),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks]))


def output_issues(analysis: DataFrame) -> Column:
    """Names of broken rules of an analysis's texts, closed vocabularies and quotes, in a fixed order; `analysis_issues` has the rest."""
    short = lambda c, least, most: F.coalesce(~F.length(F.trim(c)).between(least, most), F.lit(True))
    outside = lambda c, words: ~F.coalesce(F.col(c).isin(list(words)), F.lit(False))
    url = lambda c: ~F.coalesce(F.regexp_like(c, F.lit("^https?://[^/ ]+")), F.lit(False))
    quotes = F.coalesce("evidence_quotes", F.expr("CAST(array() AS array<struct<source_type:string,source_url:string,quote:string>>)"))
    bad_quote = F.exists(quotes, lambda q: ~F.coalesce(q["source_type"].isin("html", "pdf"), F.lit(False)) | url(q["source_url"]) | short(q["quote"], 1, 500))
    checks = [
        ("is_target", F.col("is_target").isNull()), ("document_type", outside("document_type", DOCUMENT_TYPES)), *[(c, short(F.col(c), 0, 2000)) for c in ("problem_summary", "desired_state", "request_to_private_sector")],
        ("company_relevance", outside("company_relevance", RELEVANCE)), ("contact_recommendation", outside("contact_recommendation", CONTACT)), ("reason", short(F.col("reason"), 1, 2000)),
        ("evidence_quotes", ~F.size(quotes).between(1, 5)), ("evidence_quote", bad_quote),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks]))


#: What an analyzer has to give.
ANALYSIS = T.StructType([
    T.StructField("is_target", T.BooleanType()), *[T.StructField(n, T.StringType()) for n in ("document_type", "problem_summary", "desired_state", "request_to_private_sector")], T.StructField("categories", T.ArrayType(T.StringType())),
    *[T.StructField(n, T.StringType()) for n in ("company_relevance", "contact_recommendation", "reason")],
    T.StructField("evidence_quotes", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("source_type", "source_url", "quote")]))),
])


def json_schema() -> dict:
    """The JSON schema of ANALYSIS, with its closed vocabularies and bounds."""
    words = {"document_type": DOCUMENT_TYPES, "company_relevance": list(RELEVANCE), "contact_recommendation": list(CONTACT)}

    def of(name: str, kind: T.DataType) -> dict:
        if isinstance(kind, T.StructType):
            return {"type": "object", "properties": {f.name: of(f.name, f.dataType) for f in kind.fields}, "required": kind.names, "additionalProperties": False}
        if isinstance(kind, T.ArrayType):
            inner = {"enum": NEED_CATEGORIES, "type": "string"} if name == "categories" else of(name[:-1], kind.elementType)
            return {"type": "array", "items": inner} | ({"maxItems": 3} if name == "categories" else {"minItems": 1, "maxItems": 5})
        if isinstance(kind, T.BooleanType):
            return {"type": "boolean"}
        bounds = {"reason": (1, 2000), "quote": (1, 500)}.get(name, (0, 2000))
        return {"type": "string", "enum": words[name]} if name in words else {"type": "string", "enum": ["html", "pdf"]} if name == "source_type" else {"type": "string", "minLength": bounds[0], "maxLength": bounds[1]}

    return {"$schema": "https://json-schema.org/draft/2020-12/schema"} | of("analysis", ANALYSIS)


def read_output(rows: DataFrame, envelope: str) -> DataFrame:
    """`rows` with `analysis`, the struct inside an analyzer's envelope, `stage` and `issues`: stages are those of `envelope_stage`, and 8 where keys or rules are broken.

    Columns of these names are replaced; where a stage fails, the analysis is null.
    """
    rows = rows.drop("analysis", "stage", "issues")
    name = unused(rows, "inner")
    inner = unfenced(F.try_variant_get(F.try_parse_json(F.col(envelope)), "$.result", "string"))
    rows = rows.withColumns({name: inner, "stage": envelope_stage(F.col(envelope))}).withColumn("analysis", F.from_json(name, ANALYSIS, {"mode": "PERMISSIVE"}))
    keys = F.coalesce(F.json_object_keys(name), F.array().cast("array<string>"))
    strange = (F.size(F.array_except(keys, F.array(*[F.lit(n) for n in ANALYSIS.names]))) > 0) | (F.size(F.array_distinct(keys)) < len(ANALYSIS.names))
    flat = rows.select("*", *[F.col(f"analysis.{n}").alias(n) for n in ANALYSIS.names]) if not set(ANALYSIS.names) & set(rows.columns) else None
    if flat is None:
        raise ValueError("the rows have columns of an analysis already")
    rules = analysis_issues(F.coalesce("is_target", F.lit(False)), F.coalesce("categories", F.array().cast("array<string>")), F.coalesce("company_relevance", F.lit("")), F.coalesce("contact_recommendation", F.lit("")), F.coalesce("reason", F.lit("")))
    issues = F.when(F.col("stage") != 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.when(strange, F.array(F.lit("keys"))).otherwise(F.array().cast("array<string>")), output_issues(flat), rules)))
    flat = flat.withColumn("issues", issues)
    stage = F.when((F.col("stage") == 0) & (F.size("issues") > 0), 8).otherwise(F.col("stage"))
    return flat.withColumn("stage", stage).withColumn("analysis", F.when(F.col("stage") == 0, F.col("analysis"))).drop(name, *ANALYSIS.names)


def unfenced(c: Column) -> Column:
    """What a code fence around the whole string holds; other strings trimmed."""
    t = F.trim(c)
    inner = F.regexp_extract(t, r"(?is)^```(?:json)?[ \t]*\r?\n(.*?)\r?\n[ \t]*```$", 1)
    return F.when(inner != "", inner).otherwise(t)


def envelope_stage(c: Column) -> Column:
    """The stage at which an analyzer's envelope fails (1 to 5, 7), or 0."""
    v = F.try_parse_json(c)
    text = lambda path: F.try_variant_get(v, path, "string")
    result = text("$.result")
    kind = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | ~F.startswith(kind, F.lit("OBJECT")), 1).when(~F.coalesce(text("$.type") == "result", F.lit(False)), 2).when(~F.coalesce(text("$.subtype") == "success", F.lit(False)), 3)
        .when(~F.coalesce(~F.try_variant_get(v, "$.is_error", "boolean"), F.lit(False)), 4).when(result.isNull(), 5).when(F.try_parse_json(unfenced(result)).isNull(), 7).otherwise(0)
    )


def input_tokens(envelope: Column) -> Column:
    """The number of input tokens that an analyzer's envelope tells, or null; never an error."""
    return F.try_variant_get(F.try_parse_json(envelope), "$.usage.input_tokens", "double")


# Names whose assignments are hidden in reports.
SECRET_NAMES = ["NOTION_TOKEN", "ANTHROPIC_API_KEY", "OPENAI_API_KEY", "CLAUDE_API_KEY", "API_KEY", "ACCESS_TOKEN", "AUTH_TOKEN", "TOKEN"]


def redacted(c: Column) -> Column:
    """A text for a report: line ends as LF, control characters as U+FFFD, bearer tokens, keys and assignments of secrets hidden."""
    c = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "\ufffd")
    c = F.regexp_replace(c, r"(?i)((?<![0-9A-Za-z_])Bearer\s+)[A-Za-z0-9._~+/-]+={0,2}", "$1[REDACTED]")
    c = F.regexp_replace(c, r"(?i)(?<![0-9A-Za-z_])(?:sk-(?:ant-)?[A-Za-z0-9_-]{10,}|secret_[A-Za-z0-9_-]{10,}|ntn_[A-Za-z0-9_-]{10,})(?![0-9A-Za-z_])", "[REDACTED]")
    for name in SECRET_NAMES:
        c = F.regexp_replace(c, rf"""(?i)(["']?{name}["']?\s*[:=]\s*)(?:"[^"\r\n]*"|'[^'\r\n]*'|[^\s,}}\]]+)""", "$1[REDACTED]")
    return c


def error_context(text: Column, at: Column, around: int = 200) -> Column:
    """What stands around a place (from 0) of a text, `around` characters on each side."""
    begin = F.greatest(at - around, F.lit(0))
    return F.substring(text, (begin + 1).cast("int"), (at - begin + around).cast("int"))


def evidence_found(quotes: DataFrame, texts: DataFrame, keys: list[str], quote: str = "quote", text: str = "text") -> DataFrame:
    """`quotes` with matched: whether the text of the same keys, and no other, holds the quote; both normalised."""
    t, q = unused(quotes, "own_text"), unused(quotes, "own_quote")
    of = texts.select(*keys, for_evidence(F.col(text)).alias(t))
    rows = quotes.withColumn(q, for_evidence(F.col(quote))).join(of, keys, "left")
    return rows.withColumn("matched", F.coalesce((F.col(q) != "") & F.contains(t, F.col(q)), F.lit(False))).drop(q, t)


class Analyzers:
    """Providers by name; a provider turns a DataFrame of inputs into one of analyses."""

    def __init__(self) -> None:
        self._known = {"mock": mock_analysis}

    def register(self, name: str, provider) -> None:
        self._known[name] = provider

    def get(self, name: str, write: bool = False):
        if name not in self._known:
            raise KeyError(f"no analyzer {name!r}")
        if write and name == "mock":
            raise ValueError("the mock analyzer's results are never written")
        return self._known[name]


def exact_sum(values: Iterator[float]) -> float:
    """The correctly rounded sum; infinities and NaN as in IEEE, of nothing -0.0."""
    import math

    v = list(values)
    if not v or all(x == 0 and math.copysign(1, x) < 0 for x in v):
        return -0.0
    if any(x != x for x in v) or {math.inf, -math.inf} <= set(v):
        return math.nan
    if math.inf in v or -math.inf in v:
        return math.inf if math.inf in v else -math.inf
    try:
        return math.fsum(v)
    except OverflowError:
        from fractions import Fraction

        total = sum(map(Fraction, v))
        try:
            return float(total)
        except OverflowError:
            return math.inf if total > 0 else -math.inf


_SCALE = 1074  # every finite double is a whole number of 2**-1074


def _partial(values) -> tuple[bytes, str]:
    """The exact sum of the finite values, as a whole number of 2**-1074, and a letter for each other kind of value that is there."""
    import math

    total, kinds = 0, set()
    for x in values:
        if x != x:
            kinds.add("n")
        elif math.isinf(x):
            kinds.add("p" if x > 0 else "m")
        else:
            if x or math.copysign(1, x) > 0:
                kinds.add("z")
            a, b = x.as_integer_ratio()
            total += a * ((1 << _SCALE) // b)
    return total.to_bytes(total.bit_length() // 8 + 1, "little", signed=True), "".join(sorted(kinds))


def exact_sums(df: DataFrame, keys: list[str], value: str, name: str = "total") -> DataFrame:
    """keys and the correctly rounded sum of `value` of each, nulls apart; infinities and NaN as in IEEE, of nothing -0.0.

    Each task adds exactly and hands on one number of some hundred bytes a key and batch, so no task holds the rows of a key.
    """
    import math

    parts = T.StructType([*(df.schema[k] for k in keys), T.StructField("part", T.BinaryType()), T.StructField("kinds", T.StringType())])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*(k if isinstance(k, tuple) else (k,)), *_partial(x for x in g[value].tolist() if x is not None and not (x is pd.NA))) for k, g in b.groupby(keys, dropna=False)]
            yield pd.DataFrame(rows, columns=[*keys, "part", "kinds"])

    def whole(key: tuple, g: pa.Table) -> pa.Table:
        kinds, total = set("".join(g.column("kinds").to_pylist())), sum(int.from_bytes(x, "little", signed=True) for x in g.column("part").to_pylist())
        if "n" in kinds or {"p", "m"} <= kinds:
            out = math.nan
        elif kinds & {"p", "m"}:
            out = math.inf if "p" in kinds else -math.inf
        elif not total:
            out = 0.0 if "z" in kinds else -0.0
        else:
            try:
                out = total / (1 << _SCALE)
            except OverflowError:
                out = math.inf if total > 0 else -math.inf
        return pa.table([*[pa.array([k.as_py()], k.type) for k in key], pa.array([out], pa.float64())], names=[*keys, name])  # pandas would take NaN for a null

    out = T.StructType([*(df.schema[k] for k in keys), T.StructField(name, T.DoubleType())])
    found = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias(value)).mapInPandas(add, parts)
    return found.groupBy(*keys).applyInArrow(whole, out)


def decimal_sum(c: Column, scale: int = 2) -> Column:
    """The exact sum of values of a bounded scale: no order of addition changes it."""
    return F.sum(c.cast(f"decimal(18,{scale})"))
