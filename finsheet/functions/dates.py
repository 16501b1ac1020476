"""Dates from filings. Nothing here reads the clock: what depends on today takes ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FAR = 10**9


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def iso_date(x) -> Column:
    return F.try_to_date(F.substring(_c(x).cast("string"), 1, 10), "yyyy-MM-dd")


def days_apart(a, b) -> Column:
    """Absolute distance in days; a missing side is very far."""
    return F.coalesce(F.abs(F.datediff(_c(a), _c(b))), F.lit(FAR))


def epoch_month(ms) -> Column:
    """``YYYY-MM`` in UTC of epoch milliseconds (values too small for that are seconds)."""
    v = F.when(F.abs(_c(ms)) < 10**11, _c(ms) * 1000).otherwise(_c(ms)).cast("long")
    days = F.floor(v / 86_400_000).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM")


def period_end(period) -> Column:
    """Last day of ``YYYY-MM`` as ``DD/MM/YYYY``."""
    return F.date_format(F.last_day(F.to_date(F.concat(_c(period), F.lit("-01")))), "dd/MM/yyyy")


def years_in(x, low: int = 1990, high: int = 2100) -> Column:
    found = F.regexp_extract_all(_c(x), F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), F.lit(1))
    return F.filter(F.transform(found, lambda v: v.cast("int")), lambda v: (v >= low) & (v <= high))


def latest_year(x, low: int = 1990, high: int = 2100) -> Column:
    return F.array_max(years_in(x, low, high))


def is_fresh(date, as_of, days: int = 280) -> Column:
    return F.datediff(_c(as_of), _c(date)) <= days


def year_passes(year, floor: int, strict: bool = False) -> Column:
    """A known year must reach the floor; an unknown one passes unless ``strict``."""
    return F.coalesce(_c(year) >= floor, F.lit(not strict))


def roc_year(year) -> Column:
    return _c(year) - 1911
