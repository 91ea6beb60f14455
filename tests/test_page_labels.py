"""Labels of page text: what is looked at is made once a label."""

from conftest import SF

from filingspark.operators import statements
from filingspark.plans import registry


def test_numbers_are_parsed_once_a_label(spark):
    plan = registry.QUERIES["text_statements"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1
    assert "Join Inner" not in plan


def test_labels_without_a_number_give_way(spark):
    pages = spark.createDataFrame([("a", 1, "Revenue\nNet sales none Total net sales: 12"), ("a", 2, "Revenue 7 8 9 10 Total assets"), ("b", 1, "TOTAL ASSETS 5 Total liabilities (3.5)"), ("c", 1, "Net income"), ("d", 1, None)], "doc_id string, page_number int, text string")
    found = sorted((r.doc_id, r.name_raw, r.name_norm, r.value_current, r.page) for r in statements.from_pages(pages).collect())
    assert found == [("a", "Revenue", "revenue", 9.0, 2), ("b", "Total Assets", "total_assets", 5.0, 1), ("b", "Total Liabilities", "total_liabilities", -3.5, 1)]
