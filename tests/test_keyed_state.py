"""Corrections and status as keyed state: restarts, history, oracles."""

import datetime

import pytest
from conftest import SF
from oracle import matches

from filingspark.operators import facts, listing, page_sets, statements
from filingspark.plans import registry
from filingspark.streaming import jobs

ITEM = "doc_id string, statement_type string, item_ord int, name_raw string, name_norm string, value_current double, value_prior double, unit string, currency string, notes string, page int, confidence double"


@pytest.mark.parametrize("name", ["correction_history", "stream_corrections", "stream_task_status", "stream_duration_histogram"])
def test_query(spark, name):
    matches(spark, SF, registry.QUERIES[name], registry.ORACLE_SQL[name])


def _facts(spark):
    from test_reached import ITEM

    t = spark.createDataFrame([("a", "income", 1, "Net income", "net_income", 1.0, None, None, None, None, None, 0.5)], ITEM)
    none = spark.createDataFrame([], "doc_id string, statement_type string, period_start date, period_end date, confidence double")
    return facts.build_facts(t, statements.statement_totals(t), none)


def test_history_and_restart(spark, tmp_path):
    f = _facts(spark)
    fid = f.first().fact_id
    log = "fact_id string, corr_ord long, field_name string, new_value string, old_value string"
    rows = [
        (fid, 1, "value", "7", None), (fid, 2, "value", '"x"', None), (fid, 3, "label", '"L"', None), (fid, 4, "colour", '"red"', None), ("other", 5, "value", "1", None),
        (fid, 6, "value", "null", None), (fid, 7, "value", "9", None), (fid, 8, "value", "10", "8.5"), (fid, 9, "evidence", "[]", None),
    ]
    want = [
        (1, "value", "1.0", "7", True), (2, "value", "7", '"x"', False), (3, "label", '"Net income"', '"L"', True), (6, "value", "7", "null", True), (7, "value", "null", "9", True),
        (8, "value", "8.5", "10", True), (9, "source_refs", "null", "[]", True),
    ]
    shown = lambda df: sorted((r.corr_ord, r.field, r.old_value, r.new_value, r.applied) for r in df.collect())
    batch = facts.correction_history(facts.checked_corrections(spark.createDataFrame(rows, log), f))
    assert shown(batch) == want and {r.corr_ord: r.place for r in batch.collect()}[9] == 1
    got = []
    for part in (rows[:3], rows[3:7], rows[7:]):  # the query starts anew for each part
        spark.createDataFrame(part, log).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = jobs.correction_stream(facts.checked_corrections(spark.readStream.schema(log).parquet(str(tmp_path / "log")), f))
        before = len(got)
        run = stream.writeStream.outputMode("append").foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "ck"))
        run.trigger(availableNow=True).start().awaitTermination()
        assert len(got) - before == sum(r[0] == fid and r[2] != "colour" for r in part)  # a batch holds its own rows only
    assert sorted((r.corr_ord, r.field, r.old_value, r.new_value, r.applied) for r in got) == want


def test_status_restart(spark, tmp_path):
    event = "doc_id string, ts timestamp, event_ord long, status string, progress int, current_node string, error_message string"
    t = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    rows = [("a", t(1), 1, "running", 5, "load", None), ("b", t(2), 2, None, None, None, None), ("a", t(3), 3, None, 20, None, "e"), ("a", t(2), 2, "succeeded", 10, "old", None), ("b", t(9), 9, "failed", None, "x", None)]
    state = {}
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, event).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        stream = jobs.status_stream(spark.readStream.schema(event).parquet(str(tmp_path / "events")))
        run = stream.writeStream.outputMode("update").foreachBatch(lambda b, _: state.update({r.doc_id: r for r in b.collect()})).option("checkpointLocation", str(tmp_path / "ck"))
        run.trigger(availableNow=True).start().awaitTermination()
    batch = {r.doc_id: r for r in listing.task_status(spark.createDataFrame(rows, event)).collect()}
    for doc, r in batch.items():
        assert (state[doc].status, state[doc].progress, state[doc].current_node, state[doc].error_message) == (r.status, r.progress, r.current_node, r.error_message)


def test_requests_out_of_range(spark):
    p = spark.createDataFrame([("a", 1, 0, "x"), ("a", 2, 0, "y"), ("b", 1, 0, "z")], "doc_id string, page_number int, rotation int, text string")
    asked = spark.createDataFrame([("a", 1, 9), ("b", 1, 1)], "doc_id string, ord int, page_number int")
    assert page_sets.delete(p, asked).count() == 0  # one out of range, one that leaves nothing
    assert [(r.doc_id, r.rotation) for r in page_sets.rotate(p, 90, asked).collect()] == [("b", 90)]
