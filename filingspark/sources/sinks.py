"""Sinks: artifact tables, keyed upserts and deletes, JSON and Markdown."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upserted(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` with the rows of ``new`` in place of those of equal keys."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def without(existing: DataFrame, deleted: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(deleted.select(*keys).distinct(), keys, "left_anti")


#: Rows of a bucket of an artifact table, about.
BUCKET_ROWS = 1_000_000


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of this session's own in the shared checkpoint folder, gone when the
    session ends. On a cluster ``spark.checkpoint.dir`` has to name one."""
    home = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not home:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: a shared folder is needed")
        home = tempfile.mkdtemp(prefix="scratch-")
    folder = f"{home.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def bucket(key: Column, buckets: int) -> Column:
    """The bucket of a key; a constant key's is a constant, known while planning."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_artifact(df: DataFrame, folder: str, kind: str, buckets: int | None = None, key: str = "doc_id") -> None:
    """An artifact table, partitioned by a hash of its key so that one document's rows
    are in one place. There are as many buckets as the rows ask for; the number is kept
    with the table, where readers and later writes find it."""
    spark = df.sparkSession
    if buckets is None:
        buckets = max(16, -(-df.count() // BUCKET_ROWS))
    out = df.withColumn("bucket", bucket(F.col(key), buckets))
    out.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{kind}")
    layout = spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(key).alias("key"))
    layout.coalesce(1).write.mode("overwrite").json(f"{folder}/_layout/{kind}")


def layout(spark: SparkSession, folder: str, kind: str) -> tuple[int, str]:
    """(buckets, key) of an artifact table."""
    row = spark.read.schema("buckets int, key string").json(f"{folder}/_layout/{kind}/*.json").first()
    return row["buckets"], row["key"]


def replace_buckets(df: DataFrame, folder: str, kind: str) -> None:
    """Rewrites the buckets that ``df`` holds rows of and leaves the others."""
    buckets, key = layout(df.sparkSession, folder, kind)
    out = df.withColumn("bucket", bucket(F.col(key), buckets))
    out.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{folder}/{kind}")


def write_prices(prices: DataFrame, folder: str) -> None:
    """A price table (ticker, trade_date, ...) in folders by ticker and year."""
    out = prices.withColumn("year", F.year("trade_date"))
    out.hint("rebalance", "ticker", "year").write.mode("overwrite").partitionBy("ticker", "year").parquet(folder)


def write_lines(df: DataFrame, column: str, folder: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(folder)


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)
