"""What no query reaches: each function once, on a few rows."""

import datetime
import json

from pyspark.sql import functions as F
from test_operators import ITEM

from filingspark.operators import export, facts, listing, page_sets, records, retrieval, signals, statements, tables
from filingspark.sources import readers, sinks
from filingspark.streaming import jobs

REFS = f"array<{facts.REF}>"


def test_bare_page_lists_and_paths(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"page_number": 1, "text": "x"}, {"page_number": 2, "text": "y"}]))
    (tmp_path / "b.json").write_text("[]")
    (tmp_path / "c.json").write_text("{broken")
    pages, rejected = readers.read_pages(spark, str(tmp_path))
    assert sorted((r.doc_id, r.page_number, r.text) for r in pages.collect()) == [("a", 1, "x"), ("a", 2, "y")]
    assert sorted(r.doc_id for r in rejected.collect()) == ["b", "c"]
    cases = spark.sql("select named_struct('type', 'pdf', 'path', p) as source from values ('x/y.pdf'), ('/abs.pdf'), ('s3://b/k') t(p)")
    assert [r.source.path for r in readers.resolved(cases, "/base/").collect()] == ["/base/x/y.pdf", "/abs.pdf", "s3://b/k"]


def test_prices_and_artifacts(spark, tmp_path):
    raw = spark.createDataFrame([("A", "2024-01-02", 1.0, 10), ("A", "2024-02-02", 2.0, 20), ("B", "2024-01-02", 3.0, 30)], "Ticker string, `日期` string, Close double, VOLUME int")
    p = readers.named_prices(raw)
    got = readers.prices(p, "A", datetime.date(2024, 1, 1), datetime.date(2024, 1, 31)).collect()
    assert [(r.ticker, r.close, r.volume) for r in got] == [("A", 1.0, 10)]
    df = spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, n int")
    assert [r.n for r in readers.artifact(df, "b").collect()] == [2] and readers.artifact(df, "z").count() == 0
    new = spark.createDataFrame([("a", 1), ("b", 3), ("c", None)], "doc_id string, n int")
    assert sorted(r.doc_id for r in listing.changed(df, new).collect()) == ["b", "c"]
    sinks.write_lines(df, "doc_id", str(tmp_path / "t"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ["a", "b"]
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_small_column_rules(spark):
    one = spark.range(1)
    strings = one.select(listing.metric_strings(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit(" "))).alias("x")).first().x
    assert strings == ["b: 2"]
    assert one.select(export.valid_metric(F.lit(" Gross Margin "))).first()[0] == "gross margin" and one.select(export.valid_metric(F.lit("  "))).first()[0] is None
    box = lambda *b: one.select(tables.normalized_bbox(F.array(*map(F.lit, b)), F.lit(100.0), F.lit(200.0))).first()[0]
    assert box(10.0, 20.0, 50.0, 100.0) == [0.1, 0.1, 0.5, 0.5] and box(1.0, 2.0) is None


def test_records_by_domain(spark):
    signal = {"signal_id": "s", "category": "accruals", "title": "t", "severity": "low", "description": "d", "metrics": {"a": "1"}, "evidence": [{"ref_type": "table", "page": 1, "confidence": 0.5}]}
    bad = signal | {"severity": "extreme"}
    rows = [json.dumps([signal, bad]), json.dumps({"risk_signals": [signal]}), json.dumps({"risk_signals": [signal, bad]}), "no json"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string")
    assert [r.n for r in df.orderBy("i").select(F.size(records.signals_of(F.col("raw"))).alias("n")).collect()] == [1, 1, 0, 0]
    cells = spark.createDataFrame([(1, 1, 0.5), (0, 1, 0.5), (None, None, None), (1, 1, 2.0)], "rowspan int, colspan int, confidence double")
    good, rejected = records.quarantine(records.valid_cell(cells), F.col("valid"))
    assert (good.count(), rejected.count()) == (2, 2)


def test_statement_sources(spark):
    row = ("a", "income", 1, "Net income", "net_income", 1.0, None, None, None, None, None, 0.5)
    t = spark.createDataFrame([row], ITEM)
    x = spark.createDataFrame([row[:5] + (9.0,) + row[6:], ("a", "balance") + row[2:]], ITEM)
    got = {(r.statement_type, r.value_current) for r in statements.prefer_tables(t, x).collect()}
    assert got == {("income", 1.0), ("balance", 1.0)}
    s = spark.createDataFrame([], "doc_id string, statement_type string, period_start date, period_end date, confidence double")
    f = facts.build_facts(t, statements.statement_totals(t), s)
    assert [tuple(r) for r in facts.fact_values(f, {"ni": ("income", "net_income"), "no": ("income", "revenue")}).collect()] == [("a", 1.0, None)]
    said = statements.with_language_defaults(t, spark.createDataFrame([("a", "en")], "doc_id string, lang string")).first()
    assert (said.unit, said.currency) == ("USD millions", "USD")


def test_notes_and_evidence(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    notes = spark.createDataFrame([("a", 1, "other", "x"), ("a", 2, "other", " x ")], "doc_id string, note_ord int, note_type string, summary string")
    got = sorted((r.doc_id, r.summary) for r in signals.assembled_notes(docs, notes).collect())
    assert got == [("a", "x"), ("b", "No key notes extracted.")]
    r = lambda p, q: ("table", p, "t", None, None, None, q, 0.5, None, None)
    s = spark.createDataFrame(
        [("a", "other", "T ", "low", "d", {"k": "1"}, [r(1, "q"), r(2, "q")], "s1", 1), ("a", "other", "T", "high", "longer", {"k": "2", "z": "3"}, [r(2, "q"), r(3, "q")], "s2", 2)],
        f"doc_id string, category string, title string, severity string, description string, metrics map<string,string>, evidence {REFS}, signal_id string, sig_ord int",
    )
    m = signals.merge_signals(s).first()
    assert (m.signal_id, m.severity, m.description, m.metrics, [e.page for e in m.evidence]) == ("s1", "high", "longer", {"k": "2", "z": "3"}, [1, 2, 3])


def test_contexts(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    found = spark.createDataFrame([(1, "hit")], "query_id int, context string")
    chunks = spark.createDataFrame([(i, f"c{i}") for i in range(5)], "chunk_ord int, text string")
    got = {r.query_id: r.context for r in retrieval.fallback_context(q, found, chunks).collect()}
    assert got == {1: "hit", 2: "c0\nc1\nc2"}


def test_deletions_that_leave_nothing(spark):
    pages = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "doc_id string, page_number int")
    asked = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "doc_id string, ord int, page_number int")
    assert [(r.doc_id, r.reason) for r in page_sets.invalid_requests(pages, asked, deletion=True).collect()] == [("b", "no page left")]
    assert [(r.doc_id, r.page_number) for r in page_sets.delete(pages, asked).collect()] == [("a", 1)]


def test_streams_of_status_and_corrections(spark, tmp_path):
    event = "doc_id string, ts timestamp, event_ord long, status string, progress int, current_node string, error_message string"
    at = datetime.datetime(2024, 1, 1)
    for n, rows in enumerate(([("a", at, 1, "running", 10, "n1", None), ("b", at, 1, "running", 5, None, None)], [("a", at, 2, "succeeded", None, None, "e")])):
        spark.createDataFrame(rows, event).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        stream = spark.readStream.schema(event).parquet(str(tmp_path / "events"))
        state = lambda: spark.read.parquet(str(tmp_path / "state")) if (tmp_path / "state").exists() else None
        handed = []

        def upsert(new):
            handed.append(new.count())
            old = state()
            merged = (sinks.upserted(old, new, ["doc_id"]) if old is not None else new).collect()
            spark.createDataFrame(merged, new.schema).write.mode("overwrite").parquet(str(tmp_path / "state"))

        jobs.follow_status(stream, state, upsert, str(tmp_path / "ck")).awaitTermination()
        assert handed == [2 - n]
    got = {r.doc_id: (r.status, r.progress, r.error_message) for r in state().collect()}
    assert got == {"a": ("succeeded", 10, "e"), "b": ("running", 5, None)}

    row = ("a", "income", 1, "Net income", "net_income", 1.0, None, None, None, None, None, 0.5)
    t = spark.createDataFrame([row], ITEM)
    f = facts.build_facts(t, statements.statement_totals(t), spark.createDataFrame([], "doc_id string, statement_type string, period_start date, period_end date, confidence double"))
    fid = f.first().fact_id
    log = "fact_id string, corr_ord long, field_name string, new_value string"
    spark.createDataFrame([(fid, 1, "value", "7")], log).write.parquet(str(tmp_path / "c"))
    held, out = [], []
    query = jobs.follow_corrections(
        spark.readStream.schema(log).parquet(str(tmp_path / "c")), f, lambda: spark.createDataFrame(held, log), lambda b: held.extend(map(tuple, b.collect())), lambda df: out.extend(df.collect()), str(tmp_path / "ck2")
    )
    query.awaitTermination()
    assert [r.value for r in out] == [7.0]
