"""Statements by the path that gave them, validation results per document."""

from filingspark.operators import statements, validate


def test_tables_then_text_then_empty(spark):
    items = lambda *rows: spark.createDataFrame(list(rows), "doc_id string, statement_type string")
    docs = spark.createDataFrame([("a",), ("a",), ("b",)], "doc_id string")
    rows = statements.by_path(docs, items(("a", "income"), ("a", "income"), ("z", "income")), items(("a", "income"), ("a", "balance"), ("b", "other"))).collect()
    found = {(r.doc_id, r.statement_type): (r.path, r.n_items, r.extraction_confidence, r.issues) for r in rows}
    empty = ("none", 0, 0.2, ["llm_parse_failed", "no_line_items"])
    assert len(rows) == 6
    assert found == {("a", "income"): ("tables", 2, 0.65, []), ("a", "balance"): ("text", 1, 0.7, []), ("a", "cashflow"): empty, **{("b", k): empty for k in statements.KINDS}}
    assert statements.by_path(docs.limit(0), items(("a", "income")), items()).count() == 0


def test_checks_and_metrics_are_there_where_their_values_are(spark):
    p = spark.createDataFrame(
        [("a", [], 0.25, 10.0, 5.0, 0.5, 0.25), ("b", ["balance_missing_totals"], None, 0.0, 1.0, None, 0.25), ("c", [], None, None, 1.0, None, None)],
        "doc_id string, issues array<string>, off double, net_income double, operating_cf double, ar_growth double, rev_growth double",
    )
    found = {r.doc_id: (r.issues, r.checks, r.metrics) for r in validate.validation_results(p).collect()}
    assert found["a"] == ([], {"balance_equation": 0.25}, {"profit_to_cfo_ratio": 0.5, "ar_growth_vs_rev_growth": 0.25})
    assert found["b"] == (["balance_missing_totals"], {}, {"profit_to_cfo_ratio": 1e6})
    assert found["c"] == ([], {}, {})
