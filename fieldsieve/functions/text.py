"""Text functions as columns; only NFKC, for which Spark has no built-in, is an Arrow function."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# ECMAScript's white space, for Java's engine: Unicode white space without U+0085, with U+FEFF. One class, as Java matches alternatives by recursion.
_BLANK = r"[\s\x{FEFF}&&[^\x{85}]]"
SPACE = "(?U)" + _BLANK
OMITTED = "\n\n[...中間部分を省略...]\n\n"

# What makes an attachment's name important, fairly important, or not.
HIGH = "情報提供依頼 rfi rfc 仕様書 要求仕様 実施要領 募集要項 募集要領 公募要領 提案募集 業務内容 業務概要 事業概要 実証要領".split()
MEDIUM = "概要 説明資料 参考資料 計画 ガイドライン".split()
LOW = "申込書 申請書 応募様式 様式 チラシ フライヤー アクセスマップ 地図 料金表 評価基準 審査基準 採点表 評価項目 契約書 契約約款 入札書 委任状 質問 特記事項 見積書 見積額 配置図 作成要領".split()


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, where it names it more than once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@F.pandas_udf(T.StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def squeeze(c: Column) -> Column:
    """White space collapsed to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def stripped(c: Column) -> Column:
    """Without white space of any kind at the ends; Spark's own trim takes blanks only."""
    # a run in the middle is tried once only, at its beginning
    return F.regexp_replace(c, f"(?U)^{_BLANK}++|(?<!{_BLANK}){_BLANK}++$", "")


def for_match(c: Column) -> Column:
    """NFKC, lower case, no white space."""
    return F.regexp_replace(F.lower(nfkc(c)), SPACE + "+", "")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: None if x is None else [unicodedata.normalize("NFKC", p) for p in x if p is not None])


def normal_patterns(c: Column) -> Column:
    """An array of patterns, each as `for_match` makes it, without empty ones."""
    return F.filter(F.transform(_nfkc_all(c), lambda p: F.regexp_replace(F.lower(p), SPACE + "+", "")), lambda p: p != "")


def for_evidence(c: Column) -> Column:
    """NFKC, straight quotes, and spaces only between ASCII letters or digits."""
    # Quotes that are taken for straight ones.
    plain = F.translate(nfkc(c), "“”„‟〝〞〟‘’‚‛", '"' * 7 + "'" * 4)
    return F.regexp_replace(squeeze(plain), r"(?<![0-9A-Za-z]) | (?![0-9A-Za-z])", "")


def page_text(c: Column) -> Column:
    """Line ends as LF, blanks squeezed, no blanks before line ends, one empty line at most."""
    c = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "[\t\f\x0b ]+", " ")
    return stripped(F.regexp_replace(F.regexp_replace(c, " +\n", "\n"), "\n{3,}", "\n\n"))


def fingerprint(c: Column) -> Column:
    return F.sha2(squeeze(c), 256)


def head_tail(c: Column, most: int, marker: str = OMITTED) -> Column:
    """Over `most` characters: 70 % of the room from the head, the marker, the rest from the tail."""
    if most < 1:
        raise ValueError("the limit has to be 1 at least")
    room = most - len(marker)
    if room <= 0:
        return F.left(c, F.lit(most))
    head = -(-room * 7 // 10)
    cut = F.concat(F.left(c, F.lit(head)), F.lit(marker), F.right(c, F.lit(room - head)))
    return F.when(F.length(c) <= most, c).otherwise(cut)


def chunks(c: Column, size: int = 2000) -> Column:
    """The text in parts of `size` characters; an empty text has none."""
    n = F.ceil(F.length(c) / size).cast("int")
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(c, i * size + 1, F.lit(size))))


def preview(c: Column, most: int = 500) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("…"))).otherwise(c)


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def has_any(c: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(c, F.lit(w))
    return found


def count_present(c: Column, words: list[str]) -> Column:
    """How many of the words occur, each once."""
    return sum((F.contains(c, F.lit(w)).cast("int") for w in words), F.lit(0))


def priority(*targets: Column, high: list[str] = HIGH, medium: list[str] = MEDIUM, low: list[str] = LOW) -> Column:
    """high, medium, low or other by keywords in any of the (already normalised) targets; high goes before medium before low."""
    any_of = lambda words: F.coalesce(*[F.lit(False)]) | _or([F.coalesce(has_any(t, words), F.lit(False)) for t in targets])
    return F.when(any_of(high), "high").when(any_of(medium), "medium").when(any_of(low), "low").otherwise("other")


def _or(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def link_label(text: Column, path: Column, most: int = 30) -> Column:
    """What a link is called in a report: its text, or else the decoded last part of its path, cut."""
    name = decoded(F.regexp_extract(path, "([^/]*)$", 1))
    label = F.coalesce(F.nullif(squeeze(text), F.lit("")), F.nullif(squeeze(name), F.lit("")), path)
    return preview(label, most)


def decoded(c: Column) -> Column:
    """Percent-decoded, or as it is where it can't be."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


@F.pandas_udf(T.StringType())
def lossy_utf8(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Bytes as text, what isn't UTF-8 as U+FFFD; Spark's own decoding fails there."""
    for s in batches:
        yield s.map(lambda x: None if x is None else x.decode("utf-8", "replace").removeprefix("\ufeff"))


def strict_utf8(c: Column) -> Column:
    """Bytes as text, null where they aren't UTF-8."""
    return F.try_validate_utf8(c.cast("string"))


def japanese_spacing(c: Column, least: int = 10) -> Column:
    """Whether a blank stands between Japanese letters `least` times."""
    j = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
    return F.regexp_count(c, F.lit(f"{j}[ \t]+(?={j})")) >= least
