"""A fact's corrections are sorted once, and alike before and after they meet their facts."""

from conftest import SF
from test_keyed_state import _facts

from filingspark.operators import facts
from filingspark.plans import registry


def test_places_of_corrections_made_at_once(spark):
    f = _facts(spark)
    fid = f.first().fact_id
    rows = [(fid, 1, "value", "7"), (fid, 1, "label", '"L"'), (fid, 2, "value", "8"), (fid, 2, "label", '"M"'), (fid, 2, "evidence", "[]"), ("other", 3, "value", "1"), (fid, None, "value", "5")]
    log = spark.createDataFrame(rows, "fact_id string, corr_ord long, field_name string, new_value string")
    shown = lambda df: sorted((r.place, r.corr_ord, r.field, r.old_value) for r in df.collect())
    want = [(1, 2, "label", '"L"'), (2, 2, "source_refs", "null"), (3, 2, "value", "7"), (4, 1, "label", '"Net income"'), (5, 1, "value", "5"), (6, None, "value", "1.0")]
    assert shown(facts.history(log, f)) == shown(facts.correction_history(facts.checked_corrections(log, f))) == want


def test_one_sort_by_fact_behind_the_join(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES["correction_history"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum("Sort [fact_id" in line and "corr_ord" in line for line in plan.split("\n")) == 1
    assert plan.count("Window [") - plan.count("Window [min") - plan.count("Window [lag") == 1
