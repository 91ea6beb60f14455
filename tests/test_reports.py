"""Whole reports: sections in order, plain texts where nothing was written."""

from filingspark.operators import listing

REF = "array<struct<page:int,ref_type:string,quote:string>>"


def _inputs(spark):
    meta = spark.createDataFrame([("a", "a.pdf", 2, "2024-01-01"), ("b", None, None, None)], "doc_id string, filename string, n_pages int, created_at string")
    totals = spark.createDataFrame([("a", "balance", "cash", 2.0), ("a", "income", "cash", 1.0), ("a", "income", "revenue", -3.456)], "doc_id string, statement_type string, concept string, value double")
    signals = spark.createDataFrame([("a", 2, "Later", "low", "l", []), ("a", 1, "First", "high", None, [(3, "table", "q"), (None, "page_text", None)])], f"doc_id string, sig_ord int, title string, severity string, description string, evidence {REF}")
    notes = spark.createDataFrame([("a", 1, "guidance", "Flat.", None)], f"doc_id string, note_ord int, note_type string, summary string, source_refs {REF}")
    return meta, listing.numbers_snapshot(totals), signals, notes


def _reports(*args):
    return {r.doc_id: r.report.split("\n") for r in listing.full_report(*args).collect()}


def test_sections_in_order_and_plain_texts(spark):
    found = _reports(*_inputs(spark))
    assert found["a"] == [
        "# Trader Report for a.pdf", "", "## Executive Summary", "Parsed 2 pages for a.pdf.", "", "## Key Drivers", "- See extracted statements and notes.", "", "## Numbers Snapshot", "- cash: 2.00", "- revenue: -3.46", "",
        "## Risk Signals", "- First (high): ", "  - Evidence: page 3 (table) q", "  - Evidence: page None (page_text) ", "- Later (low): l", "", "## Notes", "- guidance: Flat.", "",
        "## Limitations", "- Not financial advice.", "- Outputs depend on PDF extraction quality.", "", "Generated at 2024-01-01.",
    ]
    heads = ["## Executive Summary", "## Key Drivers", "## Numbers Snapshot", "## Risk Signals", "## Notes", "## Limitations"]
    assert [x for x in found["b"] if x.startswith("## ")] == heads and found["b"][3] == "Parsed 0 pages for ."


def test_drafts_and_findings(spark):
    drafts = spark.createDataFrame([("a", "Said.", ["x"], ["Z."], "Deep.", ["Y.", "Z."]), ("b", "", [], None, None, None)], "doc_id string, executive_summary string, key_drivers array<string>, limitations array<string>, deep_summary string, deep_limitations array<string>")
    findings = spark.createDataFrame([("a", 1, "T", "low", "s", [(1, "table", "e")]), ("b", 1, "unseen", "low", "s", [])], f"doc_id string, sig_ord int, title string, severity string, description string, evidence {REF}")
    found = _reports(*_inputs(spark), drafts, findings)
    a = found["a"]
    assert a[3] == "Said." and a[6] == "- x" and a[-6:-2] == ["- Not financial advice.", "- Outputs depend on PDF extraction quality.", "- Y.", "- Z."]
    at = a.index("## Deep Analysis")
    assert a[at : at + 5] == ["## Deep Analysis", "Deep.", "- T (low): s", "  - Evidence: page 1 (table) e", ""] and a[at + 5] == "## Notes"
    assert "## Deep Analysis" not in found["b"] and found["b"][6] == "- See extracted statements and notes."


def test_amounts_are_rounded_by_what_the_double_holds(spark):
    values = [4453475.265, 1.005, 0.125, 0.375, -0.001, 2.675, 1e17, 123456789.0]
    totals = spark.createDataFrame([("a", "income", f"c{k}", v) for k, v in enumerate(values)], "doc_id string, statement_type string, concept string, value double")
    meta, _, signals, notes = _inputs(spark)
    a = _reports(meta, listing.numbers_snapshot(totals), signals, notes)["a"]
    at = a.index("## Numbers Snapshot") + 1
    assert a[at : at + len(values)] == [f"- c{k}: {v:.2f}" for k, v in enumerate(values)]
    metrics = spark.createDataFrame([("a", "m", 0.0000005), ("a", "n", 2.5e-7)], "doc_id string, metric string, value double")
    report = listing.markdown_report(meta.where("doc_id = 'a'"), metrics, signals.withColumn("doc_id", signals.doc_id)).first().report
    assert f"- m: {0.0000005:.6f}" in report and "- n: 0.000000" in report
