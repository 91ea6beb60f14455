"""Context packs: what a document's analysis reads, in order, up to a token budget.

Sources come from five places: the validation summary, the statement snapshot, notes,
risk signals, and what a search of the document and its first tables give. The fold
that fits them into the budget sees only lengths; texts are joined back to what was
taken and cut there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingspark.functions import text

# The token budget, and how many sources of a kind are read.
BUDGET = 12_000
NOTES, SIGNALS, TABLES = 8, 12, 4
_ORDER = {"validation": 0, "statement": 1, "note": 2, "risk_signal": 3, "hit": 4, "table": 5}


def _source(df: DataFrame, kind: str, place: Column, source_type: Column | str, title: Column, body: Column) -> DataFrame:
    said = F.lit(source_type) if isinstance(source_type, str) else source_type
    return df.select("doc_id", F.struct(F.lit(_ORDER[kind]).alias("part"), place.cast("long").alias("place")).alias("at"), said.alias("source_type"), title.alias("title"), text.stripped(body).alias("text"))


def _first(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows of each document, numbered."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where(F.col("place") <= n)


def distinct_hits(hits: DataFrame) -> DataFrame:
    """Hits (doc_id, query_id, rank, source_type, source_id, text, ...) by query and rank,
    the first of those that share type and source, or else the text's beginning."""
    key = F.coalesce(F.nullif("source_id", F.lit("")), F.left("text", F.lit(80)))
    once = Window.partitionBy("doc_id", "source_type", key).orderBy("query_id", "rank")
    return hits.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")


def sources(validation: DataFrame, snapshot: DataFrame, notes: DataFrame, signals: DataFrame, hits: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, at, source_type, title, text) of a document's sources in their order:
    validation and snapshot (doc_id, text as JSON), notes (doc_id, note_ord, note_type,
    summary), signals (doc_id, sig_ord, category, title, severity, description, metrics),
    hits with their passages, tables (doc_id, table_ord, table_id, title, raw_markdown)."""
    said = F.concat(F.col("severity"), F.lit(": "), F.col("description"), F.lit("\nMetrics: "), F.to_json("metrics"))
    found = distinct_hits(hits).withColumn("source_type", F.when(F.col("source_type") == "table", "table").otherwise("page_text"))
    found = _first(found, 1 << 30, "query_id", "rank")
    parts = [
        _source(validation, "validation", F.lit(0), "validation", F.lit("Validation summary"), F.col("text")),
        _source(snapshot, "statement", F.lit(0), "statement", F.lit("Statement snapshot"), F.col("text")),
        _source(_first(notes, NOTES, "note_ord"), "note", F.col("place"), "note", F.col("note_type"), F.col("summary")),
        _source(_first(signals, SIGNALS, "sig_ord"), "risk_signal", F.col("place"), "risk_signal", F.concat_ws(": ", "category", "title"), said),
        _source(found, "hit", F.col("place"), F.col("source_type"), F.coalesce(F.nullif("title", F.lit("")), "source_type"), F.col("text")),
        _source(_first(tables, TABLES, "table_ord"), "table", F.col("place"), "table", F.coalesce(F.nullif("title", F.lit("")), "table_id"), F.col("raw_markdown")),
    ]
    return reduce(DataFrame.unionByName, parts).where("text <> ''")


def pack(sources: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(doc_id, source_ord, source_type, title, text, tokens): a document's sources in
    order, each cut to what is left of the budget, none behind a full one."""
    costs = sources.select("doc_id", F.struct("at", text.runs(F.col("text")).alias("runs")).alias("s")).groupBy("doc_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    taken = "array<struct<n:int,cut:int,tokens:int>>"
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("used"), F.array().cast(taken).alias("out"))

    def step(acc, s):
        left = F.lit(budget) - acc["used"]
        cut = F.when(left > 0, text.fitting(s["runs"], left)).otherwise(0)
        return text.let(cut, lambda c: text.let(text.run_tokens(s["runs"], c), lambda t: F.struct(
            (acc["n"] + 1).alias("n"), (acc["used"] + t).alias("used"),
            F.when(t > 0, F.concat(acc["out"], F.array(F.struct(acc["n"].alias("n"), c.alias("cut"), t.alias("tokens"))))).otherwise(acc["out"]).alias("out"),
        )))

    # At most some fifty sources a document, so the array of what was taken stays short.
    folded = costs.select("doc_id", F.transform("s", lambda x: x["at"]).alias("at"), F.aggregate("s", zero, step, lambda a: a["out"]).alias("o"))
    kept = folded.select("doc_id", "at", F.posexplode("o").alias("source_ord", "o")).select("doc_id", "source_ord", F.get("at", F.col("o.n")).alias("at"), "o.cut", "o.tokens")
    return sources.join(kept, ["doc_id", "at"]).select("doc_id", "source_ord", "source_type", "title", F.left("text", F.col("cut")).alias("text"), "tokens")
