"""Sources: filings as binary files, page JSON, manifests, prices, artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingspark.functions import text
from filingspark.sources import sinks

MAX_BYTES = 100 * 1024 * 1024
CONTENT_TYPES = ("application/pdf", "application/octet-stream", "application/x-pdf")
PAGE_LIST = "array<struct<page_number:int,text:string>>"
_EVIDENCE = "array<struct<page:int,table_id:string,row:int,col:int,quote:string>>"
MANIFEST_SCHEMA = (
    "schema_version int, benchmark_id string, name string, cases array<struct<case_id:string,company:string,ticker:string,filing_type:string,period_end:date,"
    f"source:struct<type:string,path:string>,expected_facts:array<struct<statement_type:string,concept:string,label:string,value:double,unit:string,currency:string,period_end:date,evidence:{_EVIDENCE}>>,"
    "expected_notes:array<string>,expected_risk_categories:array<string>>>, _corrupt string"
)
_PAGE_SOURCES: dict = {}


def intake(files: DataFrame, content_type: str | None = None) -> DataFrame:
    """Binary files (path, length, content) with filename, accepted and reason.
    Only a file's head is looked at."""
    kind = F.lit(content_type) if content_type else F.lit(CONTENT_TYPES[0])
    reason = (
        F.when(~kind.isin(*CONTENT_TYPES), "content type")
        .when(F.col("length") > MAX_BYTES, "too large")
        .when(F.substring("content", 1, 4) != F.lit(b"%PDF"), "no PDF header")
    )
    name = text.safe_filename(F.substring_index("path", "/", -1))
    return files.select("path", "length", name.alias("filename"), reason.isNull().alias("accepted"), reason.alias("reason"))


def read_filings(spark: SparkSession, folder: str) -> DataFrame:
    return intake(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))


def read_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pages, rejected) of page JSON files: an object with ``pages``, or the bare
    list of them."""
    raw = spark.read.text(path, wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("doc_id"))
    held = F.when(text.stripped(F.col("value")).startswith("["), F.from_json("value", PAGE_LIST)).otherwise(F.from_json("value", f"struct<pages:{PAGE_LIST}>")["pages"])
    raw = raw.select("doc_id", held.alias("pages"))
    good = F.coalesce(F.size("pages"), F.lit(0)) > 0
    return raw.where(good).select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.*"), raw.where(~good).select("doc_id")


def resolved(cases: DataFrame, folder: str) -> DataFrame:
    """Manifest cases with their source's path, where it is relative, under ``folder``."""
    path = F.col("source.path")
    whole = path.startswith("/") | path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    return cases.withColumn("source", F.col("source").withField("path", F.when(whole, path).otherwise(F.concat(F.lit(f"{folder.rstrip('/')}/"), path))))


# Names that price tables go by.
PRICE_NAMES = {"date": "trade_date", "日期": "trade_date", "开盘": "open", "最高": "high", "最低": "low", "收盘": "close", "成交量": "volume"}


def named_prices(raw: DataFrame) -> DataFrame:
    """A price table with open, high, low, close, volume and trade_date, whatever
    the case or language of its names."""
    names = [PRICE_NAMES.get(c.strip().lower(), c.strip().lower()) for c in raw.columns]
    return raw.toDF(*names).withColumn("trade_date", F.col("trade_date").cast("date"))


def read_records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) rows of JSON lines under a declared schema."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    raw = spark.read.text(path).select("value", F.from_json("value", f"{schema}, _corrupt string", options).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    return raw.where(~bad).select("r.*").drop("_corrupt"), raw.where(bad).select(F.col("value").alias("_corrupt"))


def read_manifest(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a benchmark manifest: cases, facts, notes, categories; a manifest
    without version 1, an id or cases fails, as does a source of unknown type."""
    m = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path)
    ok = (F.col("schema_version") == 1) & (F.coalesce(F.col("benchmark_id"), F.lit("")) != "") & (F.size("cases") > 0) & F.forall("cases", lambda c: c["source"]["type"].isin("synthetic", "pdf"))
    checked = m.withColumn("cases", F.when(F.coalesce(ok, F.lit(False)), F.col("cases")).otherwise(F.raise_error(F.lit("not a valid benchmark manifest")).cast(dict(m.dtypes)["cases"])))
    c = checked.select("benchmark_id", F.explode("cases").alias("c"))
    return {
        "cases": c.select("benchmark_id", "c.case_id", "c.company", "c.ticker", "c.filing_type", "c.period_end", "c.source"),
        "facts": c.select(F.col("c.case_id").alias("doc_id"), F.explode("c.expected_facts").alias("f")).select("doc_id", F.concat_ws(":", "f.statement_type", "f.concept").alias("key"), "f.value"),
        "notes": c.select(F.col("c.case_id").alias("doc_id"), F.explode("c.expected_notes").alias("note_type")),
        "categories": c.select(F.col("c.case_id").alias("doc_id"), F.explode("c.expected_risk_categories").alias("category")),
    }


def prices(table: DataFrame, ticker: str, start, end) -> DataFrame:
    """One ticker's prices in a date range, sorted; both filters reach the scan."""
    return table.where((F.col("ticker") == ticker) & F.col("trade_date").between(start, end)).orderBy("trade_date")


def prices_near(table: DataFrame, events: DataFrame, days: int) -> DataFrame:
    """(ticker, event_date, and a price row's columns): the prices within ``days`` of the
    events (ticker, event_date), of a table in folders by ticker and year; the events'
    tickers and years prune the scan while it runs."""
    first, last = F.date_sub("event_date", days), F.date_add("event_date", days)
    asked = events.select("ticker", "event_date", F.explode(F.sequence(F.year(first), F.year(last))).alias("year")).where("year > 0")
    return table.join(asked, ["ticker", "year"]).where(F.col("trade_date").between(first, last)).drop("year")


def read_artifact(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """An artifact table; it knows its buckets."""
    table = spark.read.parquet(f"{folder}/{kind}")
    buckets, key = sinks.layout(spark, folder, kind)
    return table.withMetadata("bucket", {"buckets": buckets, "key": key})


def _buckets(table: DataFrame) -> tuple[int, str]:
    about = table.schema["bucket"].metadata
    return about["buckets"], about["key"]


def artifact(table: DataFrame, doc_id) -> DataFrame:
    """One document's rows of an artifact table; none if it is unknown. The key's bucket
    is a constant, so one partition is scanned."""
    if "bucket" not in table.columns:
        return table.where(F.col("doc_id") == F.lit(doc_id))
    buckets, key = _buckets(table)
    wanted = F.lit(doc_id).cast(table.schema[key].dataType)
    return table.where((F.col("bucket") == sinks.bucket(wanted, buckets)) & (F.col(key) == wanted)).drop("bucket")


def of_keys(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of an artifact table that equal ``wanted`` in all columns both have, the key
    among them: the buckets asked for prune the scan while it runs."""
    buckets, key = _buckets(table)
    shared = [c for c in wanted.columns if c in table.columns]
    asked = wanted.withColumn("bucket", sinks.bucket(F.col(key).cast(table.schema[key].dataType), buckets)).where("bucket >= 0")
    # Buckets are few: they come last, so that sorts look at the key first.
    return table.join(asked, [*shared, "bucket"]).drop("bucket")


def register_page_source(name: str, make) -> None:
    """Adds a source of pages: a function of DataFrames to a DataFrame."""
    _PAGE_SOURCES[name] = make


def pages_from(name: str, df: DataFrame) -> DataFrame:
    return _PAGE_SOURCES[name](df)


def with_recognized(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Pages with recognised words (doc_id, page_number, word_ord, word) in place
    of their text, where the words are not blank."""
    w = found.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_ord", "word"))), lambda x: x["word"]), " ").alias("_w"))
    j = pages.join(w, ["doc_id", "page_number"], "left")
    return j.withColumn("text", F.when(F.trim("_w") != "", F.col("_w")).otherwise(F.col("text"))).drop("_w")
