"""Retrieval over passages: token overlap, dense vectors and their mix.

A query set is a small fixed table. Passages meet queries by equi-join on
tokens, so a passage without a query's token costs nothing; top-k is a rank
per query with its group limit pushed before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingspark.functions import text

QUERY_BLOCK = 1_000
EMBED_WEIGHT, TOKEN_WEIGHT, OVERFETCH = 0.7, 0.3, 3


def passages(chunks: DataFrame, size: int = 800, overlap: int = 120) -> DataFrame:
    """Chunks cut into overlapping passages: (doc_id, chunk_ord, split_index, text)."""
    return chunks.select("doc_id", "chunk_ord", F.posexplode(text.overlapping_parts(F.col("text"), size, overlap)).alias("split_index", "text"))


def token_search(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, doc_id, score): overlap of a query's tokens, repeats
    included, over log10 of the passage's length; ties to the smaller id. A query
    that nothing matches gets the first k passages with score 0."""
    q = queries.select("query_id", F.explode(text.tokens(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    tokens = text.tokens(F.col("text"))
    d = corpus.select("doc_id", tokens.alias("t")).select("doc_id", F.size("t").alias("n"), F.explode(F.array_distinct("t")).alias("token"))
    hits = d.join(q, "token").groupBy("query_id", "doc_id").agg(F.sum("times").alias("overlap"), F.first("n").alias("n"))
    scored = hits.select("query_id", "doc_id", (F.col("overlap") / F.greatest(F.log10(F.col("n") + 1), F.lit(1.0))).alias("score"))
    # The first passages stand behind every query's hits, and count where there are none, so that hits are made once.
    first = corpus.select("doc_id").orderBy("doc_id").limit(k).agg(F.array_sort(F.collect_list("doc_id")).alias("ids")).scalar()
    last = queries.select("query_id").distinct().select("query_id", F.explode(first).alias("doc_id"), F.lit(0.0).alias("score"), F.lit(1).alias("lost"))
    order = Window.partitionBy("query_id").orderBy("lost", F.desc("score"), "doc_id")
    top = scored.withColumn("lost", F.lit(0)).unionByName(last).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    best = F.first("lost").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return top.withColumn("best", best).where("lost = best").select("query_id", "rank", "doc_id", "score")


def dense_search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, doc_id, score): inner product of L2-normalised vectors,
    exact; the query set meets every row in blocks, one array each."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # A vector's length is made once, not for each of its components.
    unit = lambda c: text.let(F.greatest(norm(c), F.lit(1e-12)), lambda n: F.transform(c, lambda x: x.cast("double") / n))
    n_blocks = queries.agg(F.greatest(F.ceil(F.count("*") / QUERY_BLOCK), F.lit(1)).alias("n")).scalar()
    q = queries.select("query_id", unit(F.col("embedding")).alias("v"), F.pmod(F.xxhash64("query_id"), n_blocks).alias("block"))
    q = q.groupBy("block").agg(F.collect_list(F.struct("query_id", "v")).alias("q"))
    v = vectors.select("doc_id", unit(F.col("embedding")).alias("v")).crossJoin(q)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = v.select("doc_id", "v", F.explode("q").alias("q")).select("doc_id", F.col("q.query_id").alias("query_id"), dot(F.col("v"), F.col("q.v")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def hybrid(dense: DataFrame, token: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, doc_id, score): 0.7 and 0.3 over the ranks in two lists."""
    e = dense.where(F.col("rank") <= k * OVERFETCH).select("query_id", "doc_id", (EMBED_WEIGHT / F.col("rank")).alias("e"))
    t = token.where(F.col("rank") <= k * OVERFETCH).select("query_id", "doc_id", (TOKEN_WEIGHT / F.col("rank")).alias("t"))
    both = e.join(t, ["query_id", "doc_id"], "full_outer").select("query_id", "doc_id", (F.coalesce("e", F.lit(0.0)) + F.coalesce("t", F.lit(0.0))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def context_text(hits: DataFrame, corpus: DataFrame, chars: int = 900) -> DataFrame:
    """(query_id, context): the hits' headed beginnings, in rank order."""
    line = F.concat(F.lit("[doc "), F.col("doc_id").cast("string"), F.lit("]\n"), F.left("text", F.lit(chars)))
    j = hits.join(corpus.select("doc_id", "text"), "doc_id")
    return j.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("context"))


def fallback_context(queries: DataFrame, contexts: DataFrame, chunks: DataFrame, n: int = 3, chars: int = 4_000) -> DataFrame:
    """(query_id, context) for all queries: those without a hit get the first
    ``n`` chunks (chunk_ord, text), cut to ``chars``."""
    first = chunks.orderBy("chunk_ord").limit(n).agg(F.array_sort(F.collect_list(F.struct("chunk_ord", "text"))).alias("c"))
    said = first.select(F.left(F.array_join(F.transform("c", lambda x: x["text"]), "\n"), F.lit(chars)).alias("t")).scalar()
    return queries.select("query_id").join(contexts, "query_id", "left").select("query_id", F.coalesce("context", said).alias("context"))
