"""PDF attachments: checks, page texts by an injected parser, warnings. No parser is shipped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.text import japanese_spacing, page_text, stripped

# What can go wrong, and limits.
ERRORS = "invalid_pdf too_many_pages parse_timeout parse_failed password_protected no_text".split()
MOST_BYTES, MOST_PAGES = 20 << 20, 500
RESULT = "page_texts array<string>, error_code string"


class PdfError(Exception):
    """Raised by a parser with one of ERRORS."""

    def __init__(self, code: str) -> None:
        if code not in ERRORS:
            raise ValueError(code)
        super().__init__(code)
        self.code = code


def extracted(files: DataFrame, parser: Callable[[bytes], list[str]], content: str = "content") -> DataFrame:
    """`files` without its bytes, with page_texts, text, page_count, empty_pages, warnings, error_code; one bad file is one row with an error.

    The parser gets the bytes of files that begin as a PDF and are not too large, and gives the text of each page; it raises
    PdfError for passwords and time-outs. Null bytes are no PDF.
    """

    def one(raw: bytes | None) -> tuple[list[str] | None, str | None]:
        if raw is None or b"%PDF-" not in raw[:1024]:
            return None, "invalid_pdf"
        if len(raw) > MOST_BYTES:
            return None, "parse_failed"
        try:
            pages = parser(raw)
        except PdfError as e:
            return None, e.code
        except Exception:  # a parser's own error is a row's error
            return None, "parse_failed"
        if not 1 <= len(pages) <= MOST_PAGES:
            return None, "too_many_pages" if pages else "invalid_pdf"
        return pages, None

    @F.pandas_udf(RESULT)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([one(x) for x in s], columns=["page_texts", "error_code"])

    keep = [c for c in files.columns if c != content]
    rows = files.select(*keep, parse(content).alias("p")).select(*keep, F.transform("p.page_texts", page_text).alias("page_texts"), F.col("p.error_code").alias("error_code"))
    rows = rows.withColumn("text", stripped(F.array_join("page_texts", "\n\n")))
    rows = rows.withColumn("error_code", F.coalesce("error_code", F.when(F.col("text") == "", "no_text")))
    rows = rows.withColumn("page_count", F.size("page_texts")).withColumn("empty_pages", F.size(F.filter("page_texts", lambda x: x == "")))
    found = F.array_compact(F.array(F.when(F.col("empty_pages") > 0, F.lit("empty_pages")), F.when(japanese_spacing(F.col("text")), F.lit("japanese_character_spacing"))))
    return rows.withColumn("warnings", F.when(F.col("error_code").isNull(), found).otherwise(F.array().cast("array<string>")))
