"""The sink: mapping to its columns, conformance, conditional append, failure stages, ids."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import chunks
from .analysis import CONTACT, DOCUMENT_LABELS, DOCUMENT_TYPES, RELEVANCE
from .dedup import first_wins
from .report import bad_outcome

# The sink's columns and their kinds.
COLUMNS = {
    "案件名": "title", "公式URL": "url", "自治体": "rich_text", "情報源": "rich_text", "対象判定": "select", "文書種別": "select", "行政課題": "rich_text", "実現したい状態": "rich_text", "民間に求めること": "rich_text",
    "分野": "multi_select", "自社関連度": "select", "コンタクト推奨度": "select", "判断理由": "rich_text", "根拠引用": "rich_text", "確認状態": "select", "登録日時": "created_time",
}

_SINK = ", ".join(f"`{n}` {'timestamp' if k == 'created_time' else 'array<string>' if k in ('rich_text', 'multi_select') else 'string'}" for n, k in COLUMNS.items())


def label(code: Column, table: dict[str, str]) -> Column:
    """The label of a code; an unknown code is an error of the job."""
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(known, code), F.raise_error(F.concat(F.lit("no label for "), F.coalesce(code, F.lit("null")))))


def sink_rows(results: DataFrame) -> DataFrame:
    """Analyses (title, url, organization, source and the analyzer's fields) as rows of the sink's 15 written columns."""
    bullets = F.array_join(F.transform("evidence_quotes", lambda q: F.concat(F.lit("・"), q["quote"])), "\n")
    text = {"自治体": F.col("organization"), "情報源": F.col("source"), "行政課題": F.col("problem_summary"), "実現したい状態": F.col("desired_state"), "民間に求めること": F.col("request_to_private_sector"), "判断理由": F.col("reason"), "根拠引用": bullets}
    one = {
        "案件名": F.col("title"), "公式URL": F.col("url"), "対象判定": F.when(F.col("is_target"), "対象").otherwise("対象外"), "文書種別": label(F.col("document_type"), dict(zip(DOCUMENT_TYPES, DOCUMENT_LABELS))), "分野": F.col("categories"),
        "自社関連度": label(F.col("company_relevance"), RELEVANCE), "コンタクト推奨度": label(F.col("contact_recommendation"), CONTACT), "確認状態": F.lit("未確認"),
    }
    return results.select(*[(chunks(text[n]) if n in text else one[n]).alias(n) for n in COLUMNS if n != "登録日時"])


def kinds(rows: DataFrame) -> DataFrame:
    """(name, kind, n_values) of the columns of `rows`, of an empty table too, with how many values each has.

    The kinds are declared by one file of a table; all rows of all files are read by them, which fails where a file holds another kind.
    """
    n = rows.agg(*[F.count(F.col(f"`{name}`")).alias(f"n{k}") for k, name in enumerate(rows.columns)])
    each = [F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.col(f"n{k}").alias("n_values")) for k, (name, kind) in enumerate(rows.dtypes)]
    return n.select(F.inline(F.array(*each)))


def mismatches(actual: DataFrame, expected: dict[str, str] = COLUMNS) -> DataFrame:
    """(name, expected, actual) where (name, kind) of a sink differ from what is expected."""
    want = actual.sparkSession.createDataFrame(list(expected.items()), "name string, expected string")
    return want.join(actual.select("name", F.col("kind").alias("actual")), "name", "left").filter("actual IS NULL OR actual <> expected").select("name", "expected", "actual")


def missing_options(wanted: DataFrame, options: DataFrame) -> DataFrame:
    """(option) of `wanted` that `options` doesn't have, each once."""
    return wanted.select("option").distinct().join(options.select("option").distinct(), "option", "left_anti")


def only_table(tables: list[str]) -> str:
    """The sink's one table; none or several are an error."""
    if len(tables) != 1:
        raise ValueError(f"one table is expected, {len(tables)} are there")
    return tables[0]


def appendable(new: DataFrame, sink: DataFrame, key: str = "公式URL") -> DataFrame:
    """Rows whose URL the sink doesn't have, each URL once, the first in order of all columns: what an append may write. Running it again gives nothing."""
    return first_wins(new, [key], new.columns).join(sink.select(key).distinct(), key, "left_anti").select(new.columns)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a sink: the last version of one in versions, or a folder of Parquet files that something else writes."""
    from ..sources.versions import VersionedTable, is_versioned

    return VersionedTable(spark, path, _SINK, "公式URL").read() if is_versioned(spark, path) else spark.read.parquet(path)


def append(new: DataFrame, path: str, options: DataFrame | None = None) -> int:
    """Appends new rows to the sink in versions at a path; refused where a category isn't among the sink's `options` (option). Returns the number of rows.

    Runs that append at once never write a URL twice: of two that began together the later one leaves out what the other has written.
    """
    from ..sources.versions import VersionedTable

    spark = new.sparkSession
    if options is not None:
        missing = missing_options(new.select(F.explode("分野").alias("option")), options)
        if names := [r.option for r in missing.limit(20).collect()]:
            raise ValueError(f"options are missing: {names}")
    rows = new.withColumn("登録日時", F.current_timestamp())
    return VersionedTable(spark, path, rows.schema, "公式URL").append(rows)


def analysis_stage(error: Column, message: Column) -> Column:
    """The failure stage of an error's class and message during analysis."""
    return F.when(error == "fetch", "html_fetch").when(error == "content", "content_extract").when((error == "analyzer") & F.contains(message, F.lit("schema")), "ai_validation").otherwise("ai_analysis")


def preparation_stage(error: Column, message: Column) -> Column:
    return F.when(error == "check", "duplicate_check").when(F.contains(message, F.lit("Unsupported category")), "ai_validation").otherwise("notion_schema")


def exit_code(statuses: DataFrame, single: bool) -> DataFrame:
    """One row, exit_code: 1 with any error, or with an unsupported row that is enabled or was asked for."""
    return statuses.agg(F.coalesce(F.max(bad_outcome(F.lit(single)).cast("int")), F.lit(0)).alias("exit_code"))


_LIMIT = re.compile("you've hit your limit", re.I)


def usage_limit(stdout: str, stderr: str) -> str | None:
    """The line that tells of a used-up limit: in the strings of an output in JSON, the output itself, then the error output."""

    def strings(x):
        if isinstance(x, str):
            yield x
        elif isinstance(x, (list, dict)):
            for y in x.values() if isinstance(x, dict) else x:
                yield from strings(y)

    try:
        inner = list(strings(json.loads(stdout)))
    except ValueError:
        inner = []
    for text in (*inner, stdout, stderr):
        for line in re.split("\r?\n", text):
            if _LIMIT.search(re.sub("[‘’ʼ]", "'", line)):
                return line.strip()
    return None


_DASHED = r"(?i)(?<![0-9a-f])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-f])"
_COMPACT = r"(?i)(?<![0-9a-f])[0-9a-f]{32}(?![0-9a-f])"


def table_id(url: Column) -> Column:
    """The dashed id in the last path segment that holds one; null where none does."""
    parts = F.reverse(F.filter(F.split(F.regexp_extract(url, "^https://[^/?#]+([^?#]*)", 1), "/"), lambda s: s != ""))

    def of(s):
        dashed, compact = F.regexp_extract(s, f"({_DASHED})", 1), F.regexp_extract(s, f"({_COMPACT})", 1)
        spelt = F.regexp_replace(compact, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
        return F.lower(F.when(dashed != "", dashed).when(compact != "", spelt))

    return F.get(F.filter(F.transform(parts, of), lambda x: x.isNotNull()), F.lit(0))
