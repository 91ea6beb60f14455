"""Hits of a token search are made once, whether a query has any or none."""

from conftest import SF

from filingspark.operators import retrieval
from filingspark.plans import registry


def test_fewer_hits_than_asked_and_none(spark):
    corpus = spark.createDataFrame([(3, "red green"), (1, "blue"), (2, "red"), (4, None)], "doc_id long, text string")
    queries = spark.createDataFrame([("few", "red red"), ("none", "black"), ("empty", None)], "query_id string, query string")
    found = sorted((r.query_id, r.rank, r.doc_id, r.score) for r in retrieval.token_search(corpus, queries, 3).collect())
    none = [(q, i, i, 0.0) for q in ("empty", "none") for i in (1, 2, 3)]
    assert found == sorted(none + [("few", 1, 2, 2.0), ("few", 2, 3, 2.0)])
    assert retrieval.token_search(corpus.limit(0), queries, 3).count() == 0


def test_passages_are_cut_into_tokens_once(spark):
    plan = registry.QUERIES["hybrid_search"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct(") == 1


def test_a_vectors_length_is_made_once(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0])], "doc_id long, embedding array<double>")
    q = spark.createDataFrame([("q", [0.0, 2.0])], "query_id string, embedding array<double>")
    df = retrieval.dense_search(v, q, 1)
    assert [tuple(r) for r in df.collect()] == [("q", 1, 1, 0.8)]
