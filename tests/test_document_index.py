"""Search within documents, pruned lookups of artifact tables."""

import math
import re
from collections import Counter

from conftest import SF
from oracle import matches
from pyspark.sql import functions as F

from filingspark.operators import document_index
from filingspark.plans import documents
from filingspark.sources import readers, sinks

CHUNKS = "doc_id string, chunk_ord int, chunk_id string, page_start int, section string, text string"
TABLES = "doc_id string, table_ord int, table_id string, page int, title string, raw_markdown string"


def plain(passages, query, k):
    words = lambda x: [t for t in re.split(r"\W+", x.lower()) if t]
    scored = []
    for at, body in enumerate(passages):
        held, said = set(words(body)), words(body)
        overlap = sum(w in held for w in words(query))
        scored.append((overlap / max(math.log10(len(said) + 1), 1.0) if said else 0.0, at))
    top = [x for x in sorted(scored, key=lambda x: (-x[0], x[1]))[:k] if x[0] > 0]
    return [at for _, at in top] or list(range(min(k, len(passages))))


def test_search_within_documents(spark, tmp_path):
    said = {"a": ["Revenue increased and cash flow improved.", "Nothing of note.", " \n ", "cash cash cash " * 30], "b": ["risk", "revenue"], "c": ["only words"]}
    chunks = spark.createDataFrame([(d, i, f"{d}{i}", i + 1, "s", t) for d, ts in said.items() for i, t in enumerate(ts)], CHUNKS)
    tables = spark.createDataFrame([("a", 0, "t0", 1, "Income", "| Revenue | 100 |"), ("b", 0, "t0", 1, None, " ")], TABLES)
    corpus = document_index.corpus(chunks, tables)
    document_index.write_index(corpus, str(tmp_path))
    index = document_index.read_index(spark, str(tmp_path))
    queries = {("a", 1): "revenue cash flow cash", ("a", 2): "absent", ("b", 1): "revenue cash flow", ("c", 7): "", ("zz", 1): "cash"}
    asked = spark.createDataFrame([(d, q, t) for (d, q), t in queries.items()], "doc_id string, query_id int, query string")
    got = Counter()
    rows = document_index.with_text(document_index.search(index, asked, 3), corpus).collect()
    order = {d: sorted({(r.kind, r.ord, r.split_index): r.text for r in corpus.where(F.col("doc_id") == d).collect()}.items()) for d in "abc"}
    for (d, q), said_ in queries.items():
        found = [(r.rank, (r.kind, r.ord, r.split_index)) for r in rows if (r.doc_id, r.query_id) == (d, q)]
        want = [] if d == "zz" else plain([t for _, t in order[d]], said_, 3)
        assert [p for _, p in sorted(found)] == [order[d][at][0] for at in want]
        got[d] += len(found)
    assert got["a"] and any(r.source_type == "table" and r.title == "Income" for r in rows)




def test_lookup_reads_one_bucket(spark, tmp_path):
    df = spark.range(400).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("doc_id"), (F.col("id") * 2).alias("n"))
    sinks.write_artifact(df, str(tmp_path), "facts", buckets=32)
    table = readers.read_artifact(spark, str(tmp_path), "facts")
    one = readers.artifact(table, "d7")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and [r.n for r in one.collect()] == [14]
    assert readers.artifact(table, "none").count() == 0
    wanted = spark.createDataFrame([("d3",), ("d300",), ("x",)], "doc_id string")
    many = readers.of_keys(table, wanted)
    assert "dynamicpruning" in many._jdf.queryExecution().executedPlan().toString().lower()
    assert sorted(r.n for r in many.collect()) == [6, 600]
    sinks.replace_buckets(df.where("doc_id = 'd3'").withColumn("n", F.lit(1).cast("long")), str(tmp_path), "facts")
    again = readers.read_artifact(spark, str(tmp_path), "facts")
    assert [r.n for r in readers.artifact(again, "d3").collect()] == [1] and sinks.layout(spark, str(tmp_path), "facts") == (32, "doc_id")


def test_query(spark):
    matches(spark, SF, documents.QUERIES["document_search"], documents.ORACLE_SQL["document_search"])


def test_the_index_is_sized_without_making_it(spark, tmp_path, monkeypatch):
    asked = []
    write = sinks.write_artifact
    monkeypatch.setattr(sinks, "write_artifact", lambda df, folder, kind, buckets=None, **kw: (asked.append(buckets), write(df, folder, kind, buckets, **kw)))
    chunks = spark.createDataFrame([(1, 0, "c0", 1, None, "net income rose")], CHUNKS)
    corpus = document_index.stored(document_index.corpus(chunks, spark.createDataFrame([], TABLES)), str(tmp_path))
    document_index.write_index(corpus, str(tmp_path))
    assert asked == [16] and corpus.count() == 1
    assert {r.token for r in document_index.read_index(spark, str(tmp_path)).collect()} == {"net", "income", "rose", ""}


def test_the_index_is_stored_by_passage(spark, tmp_path):
    chunks = spark.createDataFrame([(1, i, f"c{i}", 1, None, t) for i, t in enumerate(["net income rose", "income fell", " \n"])], CHUNKS.replace("doc_id string", "doc_id int"))
    corpus = document_index.corpus(chunks, spark.createDataFrame([], TABLES.replace("doc_id string", "doc_id int")))
    document_index.write_index(corpus, str(tmp_path))
    # A row for each passage's tokens and for its place, not for each token.
    assert readers.read_artifact(spark, str(tmp_path), "postings").count() == 4
    rows = document_index.read_index(spark, str(tmp_path)).collect()
    assert sorted((r.token, r.ord) for r in rows) == [("", 0), ("", 1), ("fell", 1), ("income", 0), ("income", 1), ("net", 0), ("rose", 0)]


def test_queries_of_many_tokens_find_the_same(spark, tmp_path, monkeypatch):
    chunks = spark.createDataFrame([("a", i, f"a{i}", 1, None, t) for i, t in enumerate(["net income rose", "cash fell", "income and cash"])], CHUNKS)
    document_index.write_index(document_index.corpus(chunks, spark.createDataFrame([], TABLES)), str(tmp_path))
    index = document_index.read_index(spark, str(tmp_path))
    asked = spark.createDataFrame([("a", 1, "income cash cash"), ("a", 2, "none")], "doc_id string, query_id int, query string")
    found = lambda: sorted((r.query_id, r.rank, r.ord, r.score) for r in document_index.search(index, asked, 2).collect())
    few = found()
    monkeypatch.setattr(document_index, "SAID", 1)
    assert few == found() == [(1, 1, 2, 3.0), (1, 2, 1, 2.0), (2, 1, 0, 0.0), (2, 2, 1, 0.0)]


def test_only_orders_of_documents_are_laid_out(spark, monkeypatch):
    laid = []
    for name in ("grids", "row_grids"):
        plain_one = getattr(documents.tables, name)
        monkeypatch.setattr(documents.tables, name, lambda rows, f=plain_one: (laid.append(rows), f(rows))[1])
    documents._document_corpus(spark, SF)
    known = spark.read.parquet(f"{SF}/documents.parquet").where("text <> ''").select(F.col("doc_id").cast("string").alias("doc_id"))
    assert len(laid) == 1 and laid[0].count() > 0 and laid[0].join(known, "doc_id", "left_anti").count() == 0
