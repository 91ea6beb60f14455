"""Span grids, table search, severities, prices by ticker and year."""

import datetime

import pytest
from conftest import SF
from oracle import matches

from filingspark.operators import signals, tables
from filingspark.plans import registry
from filingspark.sources import readers, sinks


@pytest.mark.parametrize("name", ["span_grid", "severity_summary", "top_five_signals", "event_prices"])
def test_query(spark, name):
    matches(spark, SF, registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_span_grid_replayed(spark):
    cells = [(0, 0, 0, "a", 2, 2), (1, 0, 2, "b", 1, None), (2, 1, 1, "late", 1, 1), (3, 2, 0, "c", 1, 3), (4, 2, 1, "on c", 0, 1), (5, 0, 0, "again", 1, 2)]
    rows, cols = max(c[1] + (c[4] or 1) for c in cells), max(c[2] + (c[5] or 1) for c in cells)
    want = {(r, c): ["", 1, 1, False] for r in range(rows) for c in range(cols)}
    for _, r, c, t, rs, cs in cells:
        want[r, c] = [t, rs or 1, cs or 1, False]
        for i in range(r, r + (rs or 1)):
            for j in range(c, c + (cs or 1)):
                if (i, j) != (r, c):
                    want[i, j][3] = True
    df = spark.createDataFrame([("d", 0, *c) for c in cells], "doc_id string, table_ord int, cell_ord int, row int, col int, text string, rowspan int, colspan int")
    assert {(r.row, r.col): [r.text, r.rowspan, r.colspan, r.covered] for r in tables.span_grid(df).collect()} == want


def test_tables_found(spark):
    df = spark.createDataFrame([("p1_t1", "Income", 1, "| Revenue |"), ("p2_t1", None, 22, None), ("p3_t1", "Cash", 3, "| x |")], "table_id string, title string, page int, raw_markdown string")
    ids = lambda needle: sorted(r.table_id for r in tables.found(df, needle).collect())
    assert ids("REVENUE") == ["p1_t1"] and ids("22") == ["p2_t1"] and ids(" cash ") == ["p3_t1"] and len(ids("  ")) == 3 and ids("_t1") == ["p1_t1", "p2_t1", "p3_t1"] and ids("zz") == []


def test_tables_found_by_cells(spark):
    df = spark.createDataFrame([("a", 0, "t0", None, 1, "md"), ("a", 1, "t1", "x", 2, None)], "doc_id string, table_ord int, table_id string, title string, page int, raw_markdown string")
    cells = spark.createDataFrame([("a", 0, 0, 1, "Sales"), ("a", 0, 0, 0, "Net"), ("a", 0, 1, 0, None)], "doc_id string, table_ord int, row int, col int, text string")
    ids = lambda needle: sorted(r.table_id for r in tables.found(df, needle, cells).collect())
    assert ids("net sales") == ["t0"] and ids("x") == ["t1"] and ids("sales net") == [] and ids(" ") == ["t0", "t1"]


def test_severities(spark):
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate(["low", None, "high", "odd", "medium", "high", "low"])], "doc_id string, sig_ord int, severity string")
    assert tuple(signals.severity_summary(df).first()) == ("a", 2, 1, 2, 2)
    assert [r.sig_ord for r in signals.top(df).orderBy("place").collect()] == [2, 5, 4, 0, 6]


def test_events_prune_the_price_table(spark, tmp_path):
    day = datetime.date(2020, 1, 1)
    rows = [(t, day + datetime.timedelta(days=30 * i), float(i)) for t in "ABCD" for i in range(40)]
    sinks.write_prices(spark.createDataFrame(rows, "ticker string, trade_date date, close double"), str(tmp_path / "p"))
    events = spark.createDataFrame([("B", datetime.date(2021, 1, 2)), ("Z", day)], "ticker string, event_date date")
    near = readers.prices_near(spark.read.parquet(str(tmp_path / "p")), events, 20)
    assert "dynamicpruning" in near._jdf.queryExecution().executedPlan().toString().lower()
    want = sorted(r for r in rows if r[0] == "B" and abs((r[1] - datetime.date(2021, 1, 2)).days) <= 20)
    assert sorted((r.ticker, r.trade_date, r.close) for r in near.collect()) == want and want
