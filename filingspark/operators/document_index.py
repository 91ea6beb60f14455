"""Search within a document: an inverted index of its passages.

Passages are a document's chunks, cut again into overlapping parts, and its tables
as Markdown behind them. The index is a table of (doc_id, token, passage), written
once and partitioned by a hash of doc_id; a passage's tokens lie in one row and are
parted as they are read. A query belongs to a document and meets it by (bucket,
doc_id, token): it never ranks another document's passages, only the buckets of the
documents asked are read, and of them only tokens that some query says are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filingspark.functions import text
from filingspark.operators.retrieval import passages
from filingspark.sources import readers, sinks

#: A passage within its document: chunks before tables, then by place.
PASSAGE = ("kind", "ord", "split_index")
#: Passages of a document that stand in where no passage holds a query's token.
FIRST = 50

# What a document is asked for its context.
CONTEXT_QUERIES = (
    "financial performance profitability cash flow balance sheet risk disclosures",
    "accounting policy audit opinion related party impairment contingency segment guidance",
    "revenue net income operating cash flow total assets liabilities equity validation",
)


def corpus(chunks: DataFrame, tables: DataFrame, size: int = 800, overlap: int = 120) -> DataFrame:
    """(doc_id, kind, ord, split_index, source_type, source_id, page, title, text) of
    chunks (doc_id, chunk_ord, chunk_id, page_start, section, text) and tables (doc_id,
    table_ord, table_id, page, title, raw_markdown); blank passages are left out."""
    about = chunks.select("doc_id", "chunk_ord", F.struct("chunk_id", "page_start", "section", "text").alias("c"))
    cut = passages(about.select("doc_id", F.struct("chunk_ord", "c").alias("chunk_ord"), F.col("c.text").alias("text")), size, overlap).where(F.col("text").rlike(r"\S"))
    of_chunks = cut.select(
        "doc_id", F.lit(0).alias("kind"), F.col("chunk_ord.chunk_ord").cast("long").alias("ord"), "split_index", F.lit("chunk").alias("source_type"),
        F.col("chunk_ord.c.chunk_id").alias("source_id"), F.col("chunk_ord.c.page_start").alias("page"), F.col("chunk_ord.c.section").alias("title"), text.stripped(F.col("text")).alias("text"),
    )
    # Looked at inside an array, a table's Markdown is made once; a filter of rows would make it again.
    filled = F.explode(F.filter(F.array("raw_markdown"), lambda x: x.rlike(r"\S")))
    of_tables = tables.select(
        "doc_id", F.lit(1).alias("kind"), F.col("table_ord").cast("long").alias("ord"), F.lit(0).alias("split_index"), F.lit("table").alias("source_type"),
        F.col("table_id").alias("source_id"), "page", "title", filled.alias("text"),
    )
    return of_chunks.unionByName(of_tables)


def postings(corpus: DataFrame) -> DataFrame:
    """(doc_id, tokens, kind, ord, split_index, n_tokens): a passage's distinct tokens;
    rows of the empty token list a document's first passages by number."""
    t = corpus.select("doc_id", *PASSAGE, text.tokens(F.col("text")).alias("t"))
    of_tokens = t.select("doc_id", F.array_distinct("t").alias("tokens"), *PASSAGE, F.size("t").alias("n_tokens"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(*PASSAGE))
    first = corpus.select("doc_id", F.array(F.lit("")).alias("tokens"), *PASSAGE, place.alias("n_tokens")).where(F.col("n_tokens") <= FIRST)
    return of_tokens.unionByName(first)


#: Characters of a passage to a token of the index, about.
POSTING_CHARS = 8
#: Distinct tokens of all queries that go to every task.
SAID = 1_000_000


def stored(corpus: DataFrame, folder: str) -> DataFrame:
    """The corpus written and read back: the index, its size and the texts of hits ask for it."""
    corpus.write.mode("overwrite").parquet(f"{folder}/corpus")
    return corpus.sparkSession.read.schema(corpus.schema).parquet(f"{folder}/corpus")


def write_index(corpus: DataFrame, folder: str) -> None:
    """The index as a table in buckets of doc_id, as many as the corpus's characters ask
    for: no text is cut into tokens to count them."""
    chars = corpus.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    sinks.write_artifact(postings(corpus), folder, "postings", max(16, -(-chars // (POSTING_CHARS * sinks.BUCKET_ROWS))))


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """(bucket, doc_id, token, kind, ord, split_index, n_tokens): a row for each distinct
    token of a passage, and for the empty one of a document's first passages."""
    return readers.read_artifact(spark, folder, "postings").select("bucket", "doc_id", F.explode("tokens").alias("token"), *PASSAGE, "n_tokens")


def _score(overlap: Column, n_tokens: Column) -> Column:
    return overlap / F.greatest(F.log10(n_tokens + 1), F.lit(1.0))


def search(index: DataFrame, queries: DataFrame, k: int = 6) -> DataFrame:
    """(doc_id, query_id, rank, kind, ord, split_index, score): a document's k best
    passages for each of its queries (doc_id, query_id, query): the query's tokens,
    repeats included, that a passage holds over log10 of its length; ties by place.
    A query of which no passage holds a token gets the first k passages, score 0."""
    if k > FIRST:
        raise ValueError(f"the index lists a document's first {FIRST} passages")
    said = F.explode(F.concat(text.tokens(F.col("query")), F.array(F.lit("")))).alias("token")
    asked = queries.select("doc_id", "query_id", said)
    # Documents are often asked the same: few tokens are said, and others need no shuffle.
    tokens = queries.select("query").distinct().select(said).distinct()
    if tokens.limit(SAID + 1).count() <= SAID:
        index = index.join(F.broadcast(tokens), "token", "left_semi")
    # A document's hits are dealt once, for their sums and for their ranks.
    met = readers.of_keys(index, asked).where((F.col("token") != "") | (F.col("n_tokens") <= k)).repartition("doc_id")
    hits = met.groupBy("doc_id", "query_id", *PASSAGE).agg(F.count_if(F.col("token") != "").alias("overlap"), F.max(F.when(F.col("token") != "", F.col("n_tokens"))).alias("n"))
    scored = hits.withColumn("score", F.coalesce(_score(F.col("overlap"), F.col("n")), F.lit(0.0)))
    of_query = Window.partitionBy("doc_id", "query_id")
    ranked = scored.withColumn("rank", F.row_number().over(of_query.orderBy(F.desc(F.round("score", 9)), *PASSAGE))).where(F.col("rank") <= k)
    best = F.max("score").over(of_query)
    return ranked.withColumn("best", best).where("score > 0 or best = 0").select("doc_id", "query_id", "rank", *PASSAGE, "score")


def with_text(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Hits with what the corpus says of their passages."""
    return hits.join(corpus, ["doc_id", *PASSAGE])


def context_queries(docs: DataFrame) -> DataFrame:
    """(doc_id, query_id, query): the context queries for every document."""
    asked = F.array(*[F.struct(F.lit(i).alias("query_id"), F.lit(q).alias("query")) for i, q in enumerate(CONTEXT_QUERIES)])
    return docs.select("doc_id", F.explode(asked).alias("q")).select("doc_id", "q.*")
