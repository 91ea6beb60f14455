"""Dates and periods of filings (column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of dates define what is found.
MONTH_DATE = r"(?i)\b(January|February|March|April|May|June|July|August|September|October|November|December)\s+([0-3]?\d),\s*(20\d{2}|19\d{2})\b"
ISO_DATE = r"\b(20\d{2}|19\d{2})[-/](0?[1-9]|1[0-2])[-/]([0-3]?\d)\b"


def period_end(text: Column, filename: Column) -> Column:
    """The first written date, else the first ISO date; a date that does not
    exist gives null and is not passed over."""
    hay = F.regexp_replace(F.concat(text, F.lit("\n"), filename), r"\s+", " ")
    part = lambda pattern, g: F.regexp_extract(hay, pattern, g)
    written = F.try_to_timestamp(F.concat_ws(" ", F.initcap(part(MONTH_DATE, 1)), part(MONTH_DATE, 2), part(MONTH_DATE, 3)), F.lit("MMMM d yyyy")).cast("date")
    iso = F.try_to_timestamp(F.concat_ws("-", part(ISO_DATE, 1), part(ISO_DATE, 2), part(ISO_DATE, 3)), F.lit("yyyy-M-d")).cast("date")
    return F.when(part(MONTH_DATE, 0) != "", written).otherwise(F.when(part(ISO_DATE, 0) != "", iso))


def period_label(end: Column, filing: Column) -> Column:
    """2024Q1 .. Q4 by the filing's text or the month, else H1 or H2."""
    f, m = F.lower(F.coalesce(filing, F.lit(""))), F.month(end)
    part = (
        F.when(f.contains("q1") | (m == 3), "Q1")
        .when(f.contains("q2") | f.contains("h1") | (m == 6), "Q2")
        .when(f.contains("q3") | (m == 9), "Q3")
        .when(f.contains("q4") | f.contains("annual") | f.contains("10-k") | (m == 12), "Q4")
        .when(m <= 6, "H1")
        .otherwise("H2")
    )
    return F.when(end.isNotNull(), F.concat(F.year(end).cast("string"), part))
