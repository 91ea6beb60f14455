"""Revisions of page sets: every operation is a join and a renumbering.

Pages are (doc_id, page_number, ...); requests are (doc_id, ord, page_number).
An operation on many documents is one job; requests that break a rule come back
from ``invalid_requests`` and leave their document out of the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEGREES = (0, 90, 180, 270)


def _renumber(df: DataFrame, *order: str) -> DataFrame:
    return df.withColumn("page_number", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))


def invalid_requests(pages: DataFrame, requests: DataFrame, permutation: bool = False, deletion: bool = False) -> DataFrame:
    """(doc_id, reason): pages out of range, for a reordering not each once, or for
    a deletion all of them."""
    known = pages.select("doc_id", "page_number").withColumn("_k", F.lit(1))
    n = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    j = requests.join(known, ["doc_id", "page_number"], "left").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("page_number").alias("d"), F.count_if(F.col("_k").isNull()).alias("lost"))
    j = j.join(n, "doc_id", "left")
    wrong = F.when(F.col("lost") > 0, "page out of range")
    if permutation:
        wrong = wrong.when((F.col("n") != F.col("n_pages")) | (F.col("d") != F.col("n_pages")), "not a permutation")
    if deletion:
        wrong = wrong.when(F.col("d") >= F.col("n_pages"), "no page left")
    return j.select("doc_id", wrong.alias("reason")).where("reason is not null")


def extract(pages: DataFrame, requests: DataFrame, permutation: bool = False) -> DataFrame:
    """The requested pages in the requested order, repeats allowed."""
    good = requests.join(invalid_requests(pages, requests, permutation), "doc_id", "left_anti")
    return _renumber(good.join(pages, ["doc_id", "page_number"]), "ord").drop("ord")


def reorder(pages: DataFrame, requests: DataFrame) -> DataFrame:
    return extract(pages, requests, permutation=True)


def delete(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """Pages without the requested ones; documents that would lose every page, or of
    which a page out of range is asked, stay out, as ``invalid_requests`` reports."""
    kept = pages.join(invalid_requests(pages, requests, deletion=True), "doc_id", "left_anti")
    left = kept.join(requests.select("doc_id", "page_number").distinct(), ["doc_id", "page_number"], "left_anti")
    return _renumber(left, "page_number")


def rotate(pages: DataFrame, degrees: int, requests: DataFrame | None = None) -> DataFrame:
    """Adds ``degrees`` to the rotation of the requested pages, or of all; documents of
    which a page out of range is asked stay out."""
    if degrees not in DEGREES:
        raise ValueError(f"degrees must be one of {DEGREES}")
    turned = F.pmod(F.col("rotation") + degrees, F.lit(360)).cast("int")
    if requests is None:
        return pages.withColumn("rotation", turned)
    asked = requests.select("doc_id", "page_number").distinct().withColumn("_r", F.lit(True))
    kept = pages.join(invalid_requests(pages, requests), "doc_id", "left_anti")
    return kept.join(asked, ["doc_id", "page_number"], "left").withColumn("rotation", F.when(F.col("_r"), turned).otherwise(F.col("rotation"))).drop("_r")


def merge(pages: DataFrame, parts: DataFrame) -> DataFrame:
    """Merged documents: parts are (merged_id, ord, doc_id), in order."""
    j = parts.join(pages, "doc_id").withColumn("page_number", F.row_number().over(Window.partitionBy("merged_id").orderBy("ord", "page_number")))
    return j.drop("doc_id", "ord").withColumnRenamed("merged_id", "doc_id")


def revision(requests: DataFrame, operation: str, *, source: str | None = None, degrees: int | None = None, created_at=None) -> DataFrame:
    """Manifest rows (doc_id, operation, pages, page_count, source, degrees,
    created_at) of an operation; the time is now unless one is given."""
    pages = F.transform(F.array_sort(F.collect_list(F.struct("ord", "page_number"))), lambda x: x["page_number"])
    return requests.groupBy("doc_id").agg(F.lit(operation).alias("operation"), pages.alias("pages"), F.count("*").alias("page_count")).withColumns(
        {"source": F.lit(source).cast("string"), "degrees": F.lit(degrees).cast("int"), "created_at": F.current_timestamp() if created_at is None else F.lit(created_at).cast("timestamp")}
    )
