"""Date candidates in text, periods, and timestamps at +09:00."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import nfkc

MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
# The notations in the order in which they are looked for.
_WESTERN = r"(?<![0-9A-Za-z_])(20\d{2})[年/.\-](\d{1,2})[月/.\-](\d{1,2})"
_ERA = r"令和(\d{1,2})年(\d{1,2})月(\d{1,2})日"
_TOKEN = r"(?:^|[\s（(【\[])R(\d{1,2})\.(\d{1,2})\.(\d{1,2})(?![\d.])"
_MAIL = r"(?i)(?<![0-9A-Za-z_])(\d{1,2})\s+(" + "|".join(MONTHS) + r")\s+(20\d{2})(?![0-9A-Za-z_])"
# What the platform's own dates are besides: ISO dates and times, names of months, and month/day/year.
_ISO = r"^(\d{4})-(\d{2})-(\d{2})$"
_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"
_NAMES = "(" + "|".join(MONTHS) + r")[a-z]*\.?"
_MONTH_FIRST = r"(?i)^(?:[a-z]{3,9}\.?,?\s+)?" + _NAMES + r"\s+(\d{1,2}),?\s+(\d{4})(?!\d)"
_DAY_FIRST = r"(?i)^(?:[a-z]{3,9}\.?,?\s+)?(\d{1,2})[\s-]+" + _NAMES + r",?[\s-]+(\d{4})(?!\d)"
_SLASHES = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"


def _date(text: Column, pattern: str, y: int, m: int, d: int, base: int = 0) -> Column:
    part = lambda k: F.regexp_extract(text, pattern, k)
    made = F.concat_ws("-", F.lpad((part(y).cast("int") + base).cast("string"), 4, "0"), F.lpad(part(m), 2, "0"), F.lpad(part(d), 2, "0"))
    return F.try_to_date(made, "yyyy-MM-dd")


def date_candidate(c: Column, normalised: bool = False) -> Column:
    """The first notation that occurs decides; where its date doesn't exist the result is null, without a look at the others."""
    t = c if normalised else nfkc(c)
    names = F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS]), F.lower(F.regexp_extract(t, _MAIL, 2)))
    mail = F.try_to_date(F.concat_ws("-", F.regexp_extract(t, _MAIL, 3), F.lpad(names.cast("string"), 2, "0"), F.lpad(F.regexp_extract(t, _MAIL, 1), 2, "0")), "yyyy-MM-dd")
    month = lambda p, k: F.lpad(F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS]), F.lower(F.left(F.regexp_extract(t, p, k), F.lit(3)))).cast("string"), 2, "0")
    named = lambda p, y, m, d: F.try_to_date(F.concat_ws("-", F.regexp_extract(t, p, y), month(p, m), F.lpad(F.regexp_extract(t, p, d), 2, "0")), "yyyy-MM-dd")
    zone = F.regexp_extract(t, _TIME, 1)
    # a time with an offset is a day of UTC; one without is a day where it was written
    instant = F.try_to_timestamp(F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2"))
    utc = F.when(zone == "", F.try_to_date(F.left(t, F.lit(10)), "yyyy-MM-dd")).otherwise(F.to_date(F.to_utc_timestamp(instant, F.current_timezone())))
    found = lambda p: F.regexp_like(t, F.lit(p))
    return (
        F.when(found(_WESTERN), _date(t, _WESTERN, 1, 2, 3)).when(found(_ERA), _date(t, _ERA, 1, 2, 3, 2018)).when(found(_TOKEN), _date(t, _TOKEN, 1, 2, 3, 2018))
        .when(found(_MAIL), mail).when(found(_ISO), _date(t, _ISO, 1, 2, 3))
        .when(found(_TIME), utc).when(found(_MONTH_FIRST), named(_MONTH_FIRST, 3, 1, 2)).when(found(_DAY_FIRST), named(_DAY_FIRST, 3, 2, 1)).when(found(_SLASHES), _date(t, _SLASHES, 3, 1, 2))
    )


def strict_date(c: Column) -> Column:
    """A whole YYYY-MM-DD that exists, else null."""
    return F.when(F.regexp_like(c, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_date(c, "yyyy-MM-dd"))


def at_plus_nine(ts: Column) -> Column:
    """A UTC timestamp as ISO text at +09:00, in whole seconds."""
    return F.date_format(ts + F.expr("INTERVAL 9 HOURS"), "yyyy-MM-dd'T'HH:mm:ss'+09:00'")


def effective_since(last: Column, initial: Column, manual: Column, floor: str = "2026-07-01", days: int = 3) -> Column:
    """Where a run begins: a manual date, else the last success less some days but not before the initial date, else that date or `floor`."""
    first = F.coalesce(initial, F.lit(floor).cast("date"))
    return F.coalesce(manual, F.greatest(F.date_sub(last.cast("date"), days), first), first)
