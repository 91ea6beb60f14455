import datetime
import math

import pytest
from pyspark.sql import functions as F

from filingspark.functions import dates, numbers, text
from filingspark.operators import records


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_parse_number(spark):
    cases = {
        "1,234,567.89": 1234567.89, "(1234.56)": -1234.56, "（1234.56）": -1234.56, "△1234": -1234.0, "▲7": -7.0, "－1234": -1234.0, "15.5%": 0.155,
        "50％": 0.5, "¥1000": 1000.0, "$1,000": 1000.0, "100万": 1e6, "5亿": 5e8, "3万元": 3e4, "2百万": 2e6, "": None, "  ": None, "abc": None, "1d": None, "(-5)": 5.0,
        "-": None, "1_000": 1000.0, "1e3": 1000.0, ".5": 0.5,
    }
    got = column(spark, [*cases, None], numbers.parse_number)
    for (raw, want), have in zip([*cases.items(), (None, None)], got, strict=True):
        assert have == (None if want is None else pytest.approx(want)), raw


def test_stripped_ends_where_the_text_ends(spark):
    # A line separator at the end is no end of the text.
    assert column(spark, [" \x0b\f\r\n a b\t\n ", "a \u2028", "a \x85", " \t", "", None], text.stripped) == ["a b", "a \u2028", "a \x85", "", "", None]


def test_parse_numbers_drops_footnotes(spark):
    assert column(spark, ["Revenue (1) $ 1,000 (60,000) 3.5 (500)"], numbers.parse_numbers) == [[1000.0, -60000.0, 3.5]]


def test_scale_and_short_numbers(spark):
    assert column(spark, ["USD billions", "百万元", "thousand", "千万", "亿元", "5 万", "x", None], numbers.infer_scale) == [1e9, 1e6, 1e3, 1e3, 1e8, 1e4, None, None]
    assert column(spark, [1234567.0, -2.5e9, 999.0, 1500.0, None], numbers.short_number, "double") == ["1.23M", "-2.50B", "999.00", "1.50K", None]


def test_normal_cdf(spark):
    xs = [-3.0, -1.96, -0.5, 0.0, 0.5, 1.0, 2.5]
    for x, got in zip(xs, column(spark, xs, numbers.normal_cdf, "double"), strict=True):
        assert got == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), abs=1.5e-7)


def test_period_end_and_label(spark):
    none = F.lit("")
    got = column(spark, ["Ended  December 31,\n2024 and 2023-01-01", "as of 2024/3/5", "February 30, 2024 or 2024-01-01", "nothing", "2024-02-31"], lambda x: dates.period_end(x, none))
    assert got == [datetime.date(2024, 12, 31), datetime.date(2024, 3, 5), None, None, None]
    ends = [datetime.date(2024, m, 28) for m in (3, 6, 9, 12, 5, 8)]
    assert column(spark, ends, lambda x: dates.period_label(x, F.lit(None)), "date") == ["2024Q1", "2024Q2", "2024Q3", "2024Q4", "2024H1", "2024H2"]
    assert column(spark, ends[4:], lambda x: dates.period_label(x, F.lit("10-K")), "date") == ["2024Q4", "2024Q4"]


def test_text_rules(spark):
    assert column(spark, ["合并利润表", "x Balance Sheet", "cash flow", "none"], lambda x: text.statement_type(x, F.lit(None))) == ["income", "balance", "cashflow", None]
    assert column(spark, ["1. Intro", "第二章 概述", "（一）", "IV. x", "lower case", "Total assets"], text.is_heading) == [True, True, True, True, False, True]
    assert column(spark, ["ab_c-1", "a b", "", "../x"], text.safe_id) == [True, False, False, False]
    assert column(spark, ["a b/c.pdf"], text.safe_filename) == ["a_b_c.pdf"]
    assert column(spark, ["中文字", "abcdefgh", ""], text.estimated_tokens) == [2, 2, 0]
    assert column(spark, ["Acme Holdings\nx", "line\nBig Corp. report"], lambda x: text.company(x, F.lit("f_report_2024.pdf"))) == ["Acme Holdings", "Big Corp. report"]
    assert column(spark, ["nothing here"], lambda x: text.company(x, F.lit("big-company_annual_report_FY2024.pdf"))) == ["Big Company"]
    assert column(spark, ["FORM 10-K", "quarterly report", "financial statement", "x"], lambda x: text.report_type(x, F.lit(""))) == ["Annual Report", "Quarterly Report", "Financial Statements", None]
    assert column(spark, ["600519", "000001.SZ", "AAPL"], text.is_a_share) == [True, True, False]
    assert column(spark, ["600519", "000001", "600519.SH"], text.exchange_ticker) == ["600519.SH", "000001.SZ", "600519.SH"]


def test_json_and_sections(spark):
    raw = ['{"a": 1}', 'so:\n```json\n[1, 2]\n```', 'x {"b": 2} y', "none", '{"bad": ']
    assert column(spark, raw, text.json_candidate) == ['{"a": 1}', "[1, 2]", '{"b": 2}', None, None]
    assert column(spark, ["# A\nx\n## Conclusion\nbuy\n# B", "plain"], text.conclusion) == ["buy", "plain"]


def test_truncated_fits_any_length(spark):
    texts = ["a" * 1000, "中" * 400_000, "short", "", "字a" * 500_000]
    got = column(spark, texts, lambda x: text.truncated(x, 100))
    assert got[0] == "a" * 380 and got[2:4] == ["short", ""]
    tokens = column(spark, got, text.estimated_tokens)
    assert all(0 <= n <= 100 for n in tokens) and min(tokens[0], tokens[1], tokens[4]) > 80
    assert column(spark, texts[:1], lambda x: text.truncated(x, 0)) == [""]


def test_split_prompt_overlaps_and_covers(spark):
    body = "".join(chr(97 + i % 26) for i in range(5_000))
    parts = column(spark, [body, "short", ""], lambda x: text.split_prompt(x, 200, 20))
    assert parts[1:] == [["short"], [""]] and len(parts[0]) > 5
    size, step = len(parts[0][0]), len(parts[0][0]) - 80
    assert all(body[k * step : k * step + size] == p for k, p in enumerate(parts[0]))
    assert (len(parts[0]) - 1) * step + size >= len(body) > (len(parts[0]) - 2) * step + size


def test_fitted_prompt_leaves_room_for_the_system_text(spark):
    got = column(spark, ["u" * 4_000], lambda x: records.fitted_prompt(F.lit("s" * 400), x, 1_000, 500))[0]
    assert got == "u" * 1_520
