"""Places of a span grid that nothing lies on, and how often its cells are sorted."""

from conftest import SF

from filingspark.operators import tables
from filingspark.plans import registry


def test_free_places_before_between_and_behind(spark):
    cells = [("d", 0, 1, 1, 1, "a", 1, 1), ("d", 0, 2, 2, 3, "b", 2, 1), ("d", 0, 3, 1, 1, "c", 1, 1), ("d", 0, 4, 1, 0, "over", 1, 2), ("e", 0, 1, 0, 0, None, 0, None)]
    df = spark.createDataFrame(cells, "doc_id string, table_ord int, cell_ord int, row int, col int, text string, rowspan int, colspan int")
    found = {(r.doc_id, r.row, r.col): (r.text, r.rowspan, r.colspan, r.covered) for r in tables.span_grid(df).collect()}
    want = {("d", i, j): ("", 1, 1, False) for i in range(4) for j in range(4)}
    want |= {("d", 1, 0): ("over", 1, 2, False), ("d", 1, 1): ("c", 1, 1, True), ("d", 2, 3): ("b", 2, 1, False), ("d", 3, 3): ("", 1, 1, True), ("e", 0, 0): ("", 1, 1, False)}
    assert found == want and tables.span_grid(df).count() == len(want)


def test_what_cells_lay_is_sorted_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = registry.QUERIES["span_grid"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count(" Sort [") == 2 and "SortAggregate" not in plan  # the lines of an order; what its cells lay
