"""Tables routed from candidates of several engines."""

from filingspark.operators import routing

SCHEMA = "doc_id string, engine string, engine_ord int, table_ord int, fallback boolean, page int, grid array<array<string>>, bbox array<double>, page_width double, page_height double, accuracy double"
HEAD, ROW = ["Item", "2024"], ["Cash", "1"]


def _df(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def _plumber(doc, o, page, grid, box=(0.0, 0.0, 100.0, 50.0)):
    return (doc, "pdfplumber", 0, o, False, page, grid, list(box) if box else None, 200.0, 100.0, None)


def _camelot(doc, o, page, grid, accuracy, fallback=False):
    return (doc, "camelot", 1, o, fallback, page, grid, None, 0.0, 0.0, accuracy)


def test_more_tables_then_confidence_then_the_first_engine(spark):
    df = _df(
        spark,
        _plumber("more", 0, 1, [HEAD, ROW]), _camelot("more", 0, 1, [HEAD, ROW], 20.0), _camelot("more", 1, 3, [HEAD, ROW], 20.0),
        _plumber("sure", 0, 1, [HEAD, ROW]), _camelot("sure", 0, 1, [HEAD, ROW], 99.0),
        _plumber("tie", 0, 1, [HEAD, ROW]), _camelot("tie", 0, 1, [HEAD, ROW], 75.0),
        _plumber("poor", 0, 1, [HEAD, ROW]), _camelot("poor", 0, 1, [HEAD, ROW], 9.0), _camelot("poor", 1, 2, [HEAD, ROW], 9.9), _camelot("poor", 2, 3, [], 99.0),
    )
    best = lambda engine: {(r.doc_id, r.engine) for r in routing.routed(df, engine).collect()}
    assert best("best") == {("more", "camelot"), ("sure", "camelot"), ("tie", "pdfplumber"), ("poor", "pdfplumber")}
    assert best("camelot") == {(d, "camelot") for d in ("more", "sure", "tie")}
    assert best("auto") == best("of another name") == {(d, "pdfplumber") for d in ("more", "sure", "tie", "poor")}


def test_fallback_tables_go_where_a_kept_one_is_alike(spark):
    three = [HEAD, ROW, ROW]
    df = _df(spark, _camelot("d", 0, 1, three, 90.0), _camelot("d", 1, 1, three, 90.0), _camelot("d", 2, 1, [HEAD] + three, 90.0, True), _camelot("d", 3, 1, three + three, 90.0, True), _camelot("d", 4, 2, three, 90.0, True))
    assert sorted(r.table_ord for r in routing.routed(df, merge=False).collect()) == [0, 1, 3, 4]


def test_chains_keep_the_first_id_and_boxes_of_their_parts(spark):
    df = _df(spark, _plumber("d", 0, 1, [["Balance sheet"], HEAD, ROW]), _plumber("d", 1, 2, [["Debt", "2"], ["Tax", "3"]], (20.0, 10.0, 120.0, 30.0)), _plumber("d", 2, 3, [["Balance sheet"], ["Debt", None]], None))
    t = {r.table_id: r for r in routing.routed(df).collect()}
    assert sorted(t) == ["p1_t0_merged", "p3_t2"]
    merged = t["p1_t0_merged"]
    assert (merged.page, merged.title, merged.n_rows, merged.n_cols) == (1, "Balance sheet", 5, 2)
    assert merged.raw_markdown.split("\n") == ["| Balance sheet |  |", "| --- | --- |", "| Item | 2024 |", "| Cash | 1 |", "| Debt | 2 |", "| Tax | 3 |"]
    assert [(r.page, r.bbox) for r in merged.source_refs] == [(1, [0.0, 0.0, 0.5, 0.5]), (2, [0.1, 0.1, 0.6, 0.3])]
    boxes = {(r.table_id, r.row, r.col): (r.text, r.bbox) for r in routing.cells(routing.routed(df)).collect()}
    assert boxes["p1_t0_merged", 4, 1] == ("3", [0.35, 0.2, 0.6, 0.3])
    assert boxes["p3_t2", 1, 1] == ("", None)


def test_a_repeated_header_goes_and_another_one_parts_tables(spark):
    df = _df(spark, _plumber("same", 0, 1, [["a", "b"], ROW]), _plumber("same", 1, 2, [["a", "b"], ["Tax", "3"]]), _plumber("other", 0, 1, [["a", "b"], ROW]), _plumber("other", 1, 2, [["c", "d"], ["Tax", "3"]]))
    assert {(r.doc_id, r.table_ord, r.n_rows) for r in routing.routed(df).collect()} == {("same", 0, 3), ("other", 0, 2), ("other", 1, 2)}


def test_no_candidates_no_tables(spark):
    assert routing.routed(_df(spark)).count() == 0
    assert routing.cells(routing.routed(_df(spark, ("d", "camelot", 1, 0, None, None, None, None, None, None, None)))).count() == 0


def _exchanges(df):
    """Shuffles that a plan makes itself, reused ones left out."""
    return sum(line.count(" Exchange hashpartitioning") for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "ReusedExchange" not in line)


def test_cells_are_dealt_once_by_document(spark):
    from conftest import SF

    from filingspark.plans import registry

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert {q: _exchanges(registry.QUERIES[q](spark, SF)) for q in ("table_markdown", "raw_tables", "span_grid")} == {"table_markdown": 1, "raw_tables": 1, "span_grid": 1}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_grids_of_holes_repeats_and_nulls(spark):
    from filingspark.operators import tables

    cells = spark.createDataFrame([("d", 0, 2, 1, "x"), ("d", 0, 0, 0, "a"), ("d", 0, 0, 0, "b"), ("d", 0, 1, 2, None), ("e", 1, 0, 0, "")], "doc_id string, table_ord int, row int, col int, text string")
    found = {r.doc_id: (r.n_rows, r.n_cols, r.grid) for r in tables.grids(cells).collect()}
    assert found == {"d": (3, 3, [["b", "", ""], ["", "", ""], ["", "x", ""]]), "e": (1, 1, [[""]])}
