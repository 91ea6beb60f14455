"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Everything between words: space, tab, LF, VT, FF, CR.
SEPARATORS = r"[\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage.

    On a cluster the session names it (``spark.checkpoint.dir``); only where it
    is unset, as in tests, a temporary folder is made and set.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="checkpoint-")
        atexit.register(shutil.rmtree, named, True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of the shared checkpoint folder that goes when the session ends."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    discard(spark, folder, on_exit=True)
    return folder


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read again, by
    column."""
    folder = folder or scratch(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def discard(spark: SparkSession, folder: str, on_exit: bool = False) -> None:
    """Deletes a folder that this session has written, now or when it ends, in
    whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(path) if on_exit else files.delete(path, True)


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint if a materialised table has at most ``max_rows`` rows,
    else the table as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def without(df: DataFrame, *names: str | None) -> DataFrame:
    """``df`` without columns of these names, whatever their case: results replace
    input columns of the same name."""
    taken = {n.lower() for n in names if n}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def unused(df: DataFrame, name: str) -> str:
    """``name``, with marks behind it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    An expression that a higher-order function's lambda mentions is evaluated
    for every element; binding it as a lambda variable avoids that.
    """
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
