"""Numbers as filings print them (column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of Chinese units in the order in which they are tried.
UNIT_MULTIPLIERS = (("万元", 1e4), ("亿元", 1e8), ("百万", 1e6), ("千万", 1e7), ("万", 1e4), ("亿", 1e8))
NEGATIVE_MARK = r"^[△▲\-－]"
CURRENCY_MARKS = r"^[$¥￥€£＄]+"
#: What a float may look like once marks are gone; guards every cast.
FLOAT = r"^[+-]?(?:[0-9]+(?:_[0-9]+)*\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
TOKEN = r"\(?\$?\s*[\-－]?\d[\d,]*(?:\.\d+)?\)?"


def _bind(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def parse_number(raw: Column) -> Column:
    """Double of a printed number: separators, brackets and marks for negatives,
    per cent, currency signs and Chinese unit suffixes; null if it is none.

    A bracketed number that has a minus inside turns positive, as the bracket
    sets the sign of the whole and the minus that of its content.
    """

    def marked(t):
        bracketed = (t.startswith("(") & t.endswith(")")) | (t.startswith("（") & t.endswith("）"))
        inner = F.when(bracketed & (F.length(t) >= 2), F.trim(F.substr(t, F.lit(2), F.length(t) - 2))).otherwise(t)
        lead = ~bracketed & inner.rlike(NEGATIVE_MARK)
        body = F.when(lead, F.trim(F.substr(inner, F.lit(2)))).otherwise(inner)
        return _bind(F.struct(body.alias("t"), (bracketed | lead).alias("negative")), scaled)

    def scaled(s):
        percent = s["t"].rlike("[%％]$")
        t = F.when(percent, F.trim(F.substr(s["t"], F.lit(1), F.length(s["t"]) - 1))).otherwise(s["t"])
        t = F.regexp_replace(t, CURRENCY_MARKS, "")
        return _bind(F.struct(t.alias("t"), percent.alias("percent"), s["negative"].alias("negative")), multiplied)

    def multiplied(s):
        factor, cut = F.lit(1.0), F.lit(0)
        for unit, value in reversed(UNIT_MULTIPLIERS):
            factor = F.when(s["t"].endswith(unit), value).otherwise(factor)
            cut = F.when(s["t"].endswith(unit), len(unit)).otherwise(cut)
        body = F.trim(F.substr(s["t"], F.lit(1), F.length(s["t"]) - cut))
        digits = F.when(body.rlike(FLOAT), F.replace(body, F.lit("_"), F.lit("")).try_cast("double"))
        value = F.when(s["percent"], digits / 100.0).otherwise(digits) * factor
        return F.when(s["negative"], -value).otherwise(value)

    clean = F.trim(F.regexp_replace(raw, "[, ]", ""))
    return F.when(raw.isNotNull() & (clean != ""), _bind(clean, marked))


def parse_numbers(snippet: Column) -> Column:
    """All numbers of a snippet; whole numbers in brackets are footnote marks."""
    tokens = F.regexp_extract_all(F.regexp_replace(snippet, r"\(\d+\)", ""), F.lit(TOKEN), F.lit(0))
    return F.filter(F.transform(tokens, parse_number), lambda x: x.isNotNull())


def infer_scale(unit: Column) -> Column:
    """Multiplier that a unit's text names."""
    u = F.replace(F.lower(unit), F.lit(" "), F.lit("_"))
    return (
        F.when(u.contains("billion") | u.contains("十亿"), 1e9)
        .when(u.contains("million") | u.contains("百万"), 1e6)
        .when(u.contains("thousand") | u.contains("千"), 1e3)
        .when(u.contains("亿元") | u.endswith("亿"), 1e8)
        .when(u.contains("万元") | u.endswith("万"), 1e4)
    )


def printed(x: Column, places: int) -> Column:
    """A number with fixed places, rounded by what the double holds, exact ties to even: 4453475.265 is a
    little less in binary and prints as 4453475.26. ``format_string`` rounds its decimal digits up."""
    plain = F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull()
    return F.when(plain, F.format_string(f"%.{places}f", x)).otherwise(F.call_function("format_number", x, F.lit("0." + "0" * places)))


def short_number(x: Column) -> Column:
    """1234567 as 1.23M: two decimals and K, M or B."""
    size = F.abs(x)
    shown = lambda y, mark: F.concat(printed(y, 2), F.lit(mark))
    return F.when(size >= 1e9, shown(x / 1e9, "B")).when(size >= 1e6, shown(x / 1e6, "M")).when(size >= 1e3, shown(x / 1e3, "K")).when(x.isNotNull(), shown(x, ""))


def growth(current: Column, prior: Column) -> Column:
    return (current - prior) / F.greatest(F.abs(prior), F.lit(1.0))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution by the error function's rational
    approximation 7.1.26 of Abramowitz and Stegun; absolute error under 1e-7."""
    z = F.abs(x) / F.lit(2.0**0.5)
    t = 1.0 / (1.0 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erfc = poly * F.exp(-z * z)
    return F.when(x < 0, 0.5 * erfc).otherwise(1.0 - 0.5 * erfc)
