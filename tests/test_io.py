import json

import pytest
from pyspark.sql import functions as F

from filingspark.sources import readers, sinks


def test_intake(spark, tmp_path):
    (tmp_path / "good file.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "bad.pdf").write_bytes(b"<html>")
    r = {x.filename: (x.accepted, x.reason) for x in readers.read_filings(spark, str(tmp_path)).collect()}
    assert r["bad.pdf"] == (False, "no PDF header") and [v for k, v in r.items() if k.startswith("good")] == [(True, None)]


def test_pages_and_records(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/one.json").write_text(json.dumps({"pages": [{"page_number": 1, "text": "a\nb"}]}))
    (tmp_path / "p/two.json").write_text(json.dumps({"pages": []}))
    pages, rejected = readers.read_pages(spark, str(tmp_path / "p"))
    assert [(r.doc_id, r.text) for r in pages.collect()] == [("one", "a\nb")] and [r.doc_id for r in rejected.collect()] == ["two"]
    (tmp_path / "r.json").write_text('{"a": 1}\n{"a": "x"}\nbroken\n')
    good, bad = readers.read_records(spark, str(tmp_path / "r.json"), "a int")
    assert [r.a for r in good.cache().collect()] == [1] and bad.cache().count() == 2


def test_manifest(spark, tmp_path):
    m = {"schema_version": 1, "benchmark_id": "b", "cases": [{"case_id": "c", "source": {"type": "synthetic", "path": "p"}, "expected_facts": [{"statement_type": "income", "concept": "revenue", "value": 1.0}], "expected_notes": ["n"], "expected_risk_categories": ["r"]}]}
    (tmp_path / "m.json").write_text(json.dumps(m))
    t = readers.read_manifest(spark, str(tmp_path / "m.json"))
    assert [tuple(r) for r in t["facts"].collect()] == [("c", "income:revenue", 1.0)] and t["notes"].first().note_type == "n"
    (tmp_path / "bad.json").write_text(json.dumps(m | {"schema_version": 2}))
    with pytest.raises(Exception, match="not a valid benchmark manifest"):
        readers.read_manifest(spark, str(tmp_path / "bad.json"))["facts"].collect()


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "doc_id string, v int")
    b = spark.createDataFrame([("y", 3), ("z", 4)], "doc_id string, v int")
    assert {tuple(r) for r in sinks.upserted(a, b, ["doc_id"]).collect()} == {("x", 1), ("y", 3), ("z", 4)}
    assert [r.doc_id for r in sinks.without(a, b, ["doc_id"]).collect()] == ["x"]
    sinks.write_artifact(a, str(tmp_path), "facts")
    sinks.replace_buckets(b.where("doc_id = 'y'"), str(tmp_path), "facts")
    back = {(r.doc_id, r.v) for r in spark.read.parquet(str(tmp_path / "facts")).collect()}
    assert ("y", 3) in back and ("y", 2) not in back


def test_recognised_words(spark):
    p = spark.createDataFrame([("d", 1, "old"), ("d", 2, "old")], "doc_id string, page_number int, text string")
    w = spark.createDataFrame([("d", 1, 0, "new"), ("d", 1, 1, "text"), ("d", 2, 0, " ")], "doc_id string, page_number int, word_ord int, word string")
    assert [r.text for r in readers.with_recognized(p, w).orderBy("page_number").collect()] == ["new text", "old"]
    readers.register_page_source("upper", lambda df: df.withColumn("text", F.upper("text")))
    assert readers.pages_from("upper", p).first().text == "OLD"
