"""WARC archives: written by Spark, read back, merged into capture histories.

Writing: a record per page. Among pages of equal payload (at least ``min_bytes``
long) the one of smallest page_id becomes a response record, the others revisit
records that name it; shorter payloads are all responses. Digests meet in a
count, so a common payload costs no more than a rare one, and its texts never
meet. Records are text rows whose line end is the record end, so that Spark's
writer makes valid gzip-compressed WARC files in any file system it can reach.

Reading: files, bounded by bytes as they are written, come back as binary rows
and are parsed by Content-Length; a record's offset is that in the uncompressed
archive. Every file gives a capture run sorted by URL key (SURT form) and
timestamp. Runs are dealt by range of (URL key, timestamp, page_id), so that even
one URL's history is split, and sorted within the range run by run, which Spark
does on disk where it must; each range merges its pieces of the k runs by a loser
tree, without sorting them again. The partitions in turn hold the global order.

Defined cases: null html is an empty payload, null url an empty target; a null
page_id makes a record without a number and comes behind all numbers; of rows
that repeat the smallest page_id of a payload the first by url is the response,
the others revisit it; payloads of any length that a row holds; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint_dir, discard, durable

RECORD_END = "\r\n\r\n"
RECORDS_PER_FILE = 20_000
OUT_ROWS = 10_000
FILE_BYTES = 1 << 28
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = "urlkey string, ts string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, run string, offset long"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 32 digits of five bits, 20 bits at a time."""
    digest = F.sha1(payload)
    parts = [F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int") for g in range(8)]
    digit = lambda v, k: F.substr(F.lit(BASE32), F.call_function("shiftright", v, F.lit(15 - 5 * k)).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*[digit(v, k) for v in parts for k in range(4)])


def write_warc(pages: DataFrame, folder: str, *, min_bytes: int = 0) -> None:
    """Archives of (page_id, url, html) under ``folder``."""
    payload = F.coalesce("html", F.lit(""))
    size = F.octet_length(payload).cast("long")
    # A digest may be common: what meet are ids and counts, never payloads.
    digests = pages.select("page_id", base32_sha1(payload).alias("digest"), size.alias("size"))
    ids = durable(digests.groupBy("digest", "page_id", "size").agg(F.count("*").alias("c")))
    n, total = ids.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(F.col("c") * F.col("size")), F.lit(0))).first()
    per_file = max(1, min(RECORDS_PER_FILE, FILE_BYTES * n // max(1, total)))
    shared = ids.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.sum("c").alias("n")).where("n > 1")
    # Only payloads that repeat need their first page, and only its followers.
    repeated = (F.col("c") > 1) & F.col("page_id").eqNullSafe(F.col("first"))
    f = ids.join(shared, "digest").where("page_id is null or page_id > first or c > 1").select(F.col("page_id").alias("f_page"), "first", F.col("digest").alias("f_digest"), repeated.alias("repeated"))
    f = durable(f.where("repeated or not f_page <=> first"))
    one = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    one = one.withColumn("own", base32_sha1(F.col("payload")))
    r = one.join(f, F.col("page_id").eqNullSafe(F.col("f_page")) & (F.col("own") == F.col("f_digest")), "left")
    kept = ["page_id", "url", "payload", "own", "first"]
    if not f.where("repeated").isEmpty():
        # Rows of one page and payload: equal ones are counted, not gathered.
        twins = r.where("repeated").groupBy("page_id", "url", "own", "first").agg(F.first("payload").alias("payload"), F.count("*").alias("k"))
        lead = F.min("url").over(Window.partitionBy("page_id", "own"))
        twins = twins.withColumn("lead", lead).select(*kept, "lead", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))).alias("nth"))
        plain = r.where("not coalesce(repeated, false)").select(*kept, F.col("f_digest").isNotNull().alias("revisit"))
        r = plain.unionByName(twins.select(*kept, ((F.col("url") != F.col("lead")) | (F.col("nth") > 1)).alias("revisit")))
    else:
        r = r.select(*kept, F.col("f_digest").isNotNull().alias("revisit"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload"), F.lit(RECORD_END))
    revisit = F.col("revisit")
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    url = F.regexp_replace("url", r"[\r\n]", "")
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_577_836_800) + F.coalesce(F.col("page_id"), F.lit(0)) % 1_000_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    number = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), number,
        F.lit(">\r\nWARC-Date: "), stamp,
        F.lit("\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("own"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.coalesce(F.col("first").cast("string"), F.lit("")), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit(RECORD_END),
    )
    r.select(F.concat(head, body).alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder)


def url_key(url: str) -> str:
    """SURT form: host labels reversed, then the path, lower-case, no fragment."""
    rest = url.split("#", 1)[0].split("://", 1)[-1]
    host, slash, path = rest.partition("/")
    host = host.rsplit("@", 1)[-1].split(":", 1)[0].lower()
    labels = host.removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + ")" + (slash + path).lower()


def records(data: bytes) -> Iterator[tuple[int, dict[str, str], memoryview]]:
    """(offset, headers, block) of the records of an uncompressed archive."""
    at, view = 0, memoryview(data)
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        start = end + 4
        stop = start + int(headers["Content-Length"])
        yield at, headers, view[start:stop]
        at = stop + 4


def _captures(content: bytes, run: str) -> list[tuple]:
    """A sorted run: the capture index of one archive."""
    import base64
    import gzip
    import hashlib
    import re

    def page(value: str | None):
        number = re.search(r"<urn:page:(-?\d+)>", value or "")
        return int(number[1]) if number else None

    found = []
    for offset, h, block in records(gzip.decompress(content)):
        http, _, payload = bytes(block).partition(b"\r\n\r\n")
        kind, digest = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        if kind == "response" and (size != len(payload) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"a payload differs from its digest at {offset} of {run}")
        url = h["WARC-Target-URI"]
        found.append((url_key(url), h["WARC-Date"], page(h["WARC-Record-ID"]), url, kind, size, digest, page(h.get("WARC-Refers-To")), run, offset))
    return sorted(found, key=_order)


def _order(capture: tuple) -> tuple:
    return capture[0], capture[1], capture[2] is not None, capture[2] or 0, capture[8], capture[9]


def merged(runs: list[Iterable]) -> Iterator:
    """K-way merge of sorted runs by a loser tree: a leaf per run, each inner
    node the loser of the match below it, one replay from leaf to root per item."""
    k = len(runs)
    if not k:
        return
    ends = [iter(r) for r in runs]
    items = [next(e, None) for e in ends]
    keys = [None if x is None else _order(x) for x in items]

    def beats(a: int, b: int) -> bool:  # exhausted runs lose
        return keys[b] is None or (keys[a] is not None and (keys[a], a) <= (keys[b], b))

    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    top = winners[1] if k > 1 else 0
    while keys[top] is not None:
        yield items[top]
        items[top] = next(ends[top], None)
        keys[top] = None if items[top] is None else _order(items[top])
        node = (top + k) // 2
        while node:
            if not beats(top, losers[node]):
                top, losers[node] = losers[node], top
            node //= 2


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Captures in global order of (URL key, timestamp, page_id)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield _frame(_captures(bytes(content), path.rsplit("/", 1)[-1]))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs: dict[str, list[pd.DataFrame]] = {}  # columns of what is already sorted
        for batch in batches:
            for run, piece in batch.groupby("run", sort=False):
                runs.setdefault(run, []).append(piece)
        held: list[tuple] = []
        for row in merged([_rows(pieces) for _, pieces in sorted(runs.items())]):
            held.append(row)
            if len(held) == OUT_ROWS:
                yield _frame(held)
                held = []
        if held:
            yield _frame(held)

    # The runs are small beside the archives; kept, so that sampling the ranges
    # does not read the archives twice.
    indexed = durable(files.mapInPandas(index, CAPTURES))
    key = ["urlkey", "ts", "page_id"]
    ranged = indexed.repartitionByRange(*key).sortWithinPartitions("run", *key, "offset")
    # Numbers that may be null go into pandas as text, where they keep all digits.
    return ranged.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")}).mapInPandas(merge, CAPTURES)


def _rows(pieces: list[pd.DataFrame]) -> Iterator[tuple]:
    for piece in pieces:
        whole = piece.astype(object).where(piece.notna(), None)
        for c in ("page_id", "refers_to"):
            whole[c] = pd.Series([None if x is None else int(x) for x in whole[c]], index=whole.index, dtype=object)
        yield from whole.itertuples(index=False, name=None)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in CAPTURES.split(", ")]
    out = pd.DataFrame(rows, columns=names, dtype=object)
    return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64", "offset": "int64"})


def archive(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` to a new folder beside the checkpoints and reads it back."""
    spark = pages.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_warc(pages, folder, min_bytes=min_bytes)
    discard(spark, folder, on_exit=True)
    return read_warc(spark, folder)
