"""Grids of whole rows are those of their cells, whatever is missing or said twice."""

from pyspark.sql import functions as F

from filingspark.operators import tables

ROWS = [
    ("dense", 0, 1, ["b", "2"]), ("dense", 0, 0, ["a", "1"]),
    ("hole", 0, 2, ["c"]), ("hole", 0, 0, ["a", None, "x"]),
    ("twice", 0, 0, ["a", "z"]), ("twice", 0, 0, ["b", "y"]), ("twice", 0, 1, ["c", "d"]),
    ("twice and hole", 0, 0, ["a"]), ("twice and hole", 0, 0, ["b"]), ("twice and hole", 0, 2, ["c"]),
    ("none", 0, 0, []), ("null", 0, 0, None), ("below", 0, -1, ["x"]), ("other", 1, 0, ["e"]), ("other", 0, 0, ["f"]),
]


def test_row_grids_are_the_grids_of_their_cells(spark):
    rows = spark.createDataFrame(ROWS, "doc_id string, table_ord int, row int, texts array<string>")
    cells = rows.select("doc_id", "table_ord", "row", F.posexplode("texts").alias("col", "text"))
    said = lambda df: sorted((r.doc_id, r.table_ord, r.n_rows, r.n_cols, r.grid) for r in df.collect())
    found = said(tables.row_grids(rows))
    assert found == said(tables.grids(cells))
    assert [x[0] for x in found] == ["dense", "hole", "other", "other", "twice", "twice and hole"]


def test_numbers_keep_their_marks_and_spaces(spark):
    texts = [("1, 000", True), ("n an", True), (", ", False), ("", False), ("(1,000)", True), ("a1", False), (" 5 %", True), ("1_0", True), ("△7", True)]
    df = spark.createDataFrame(texts, "t string, number boolean")
    assert [r.t for r in df.where(tables.is_number(F.col("t")) != F.col("number")).collect()] == []


def test_candidates_are_made_and_dealt_once(spark):
    from conftest import SF
    from test_routing import _exchanges

    from filingspark.plans import registry

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = registry.QUERIES["routed_tables"](spark, SF)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert (_exchanges(df), plan.count("Join")) == (2, 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
