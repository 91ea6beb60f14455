"""SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint has 64 bits over four-word shingles; fingerprints link at up to
four differing bits, and documents are alike if links lead from one to the other.

Candidates: a fingerprint is cut into segments of 22, 21 and 21 bits, each a word
of the perfect (23,12) Golay code's space, where every word decodes to the one
codeword within three bits. ``near`` of a segment are the codeword indices to
which it and its one-bit neighbours decode (about five): two segments within two
bits share a ``near`` index, and within one bit the codeword of either is
``near`` the other. By pigeonhole four errors leave either

* a segment without error and another with at most two: keys (segment, near of
  another), or
* errors 1, 1, 2: keys of all three segments, where one side gives codewords and
  for one segment ``near``, and the other side ``near`` for all three.

Fingerprints that share a key are compared bit by bit in blocks of bounded size;
a block yields a spanning forest of its links, never all pairs, and a key with
more fingerprints than a block holds is cut into pairs of sub-blocks that cover
it. Only distinct fingerprints enter; copies meet in a count. Links are closed
by rounds of large-star and small-star, each checkpointed.

Defined cases: null or blank text has fingerprint 0 and is linked like any other;
repeated rows get a row each; null ids are passed over when the smallest id of a
component is taken; texts are read whole, 65,536 shingles at a time; other columns
are ignored, and kept by ``deduplicate``; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, unused

SHINGLE = 4
MAX_BITS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
BLOCK = 4096
#: Generator polynomial of the binary Golay code.
GENERATOR = 0b101011100011
_ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text, as an unsigned number."""
    import xxhash

    # bytes.split() parts at space, tab, LF, VT, FF and CR only.
    w = (text or "").encode("utf-8", "surrogatepass").translate(_ASCII_LOWER).split()
    if not w:
        return 0
    spans = [b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    return bits_of(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in spans), "<u8", len(spans))) & (1 << 64) - 1


def bits_of(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes, as a signed number: the bits that more
    than half of them have; 0 of none."""
    ones = np.zeros(64, "int64")
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="int64")
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with fp: the fingerprint's bits as a long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], "u8").view("i8"))

    return docs.select(*[c for c in docs.columns if c != text_col], fp(F.col(text_col)).alias("fp"))


_tables: dict[str, np.ndarray] = {}


def decoder() -> np.ndarray:
    """Index of the codeword within three bits, for each of the 2**23 words."""
    if "decoder" not in _tables:
        index = np.arange(4096, dtype="u4")
        words = np.zeros(4096, "u4")
        for bit in range(12):
            words ^= np.where(index >> bit & 1, np.uint32(GENERATOR << bit), np.uint32(0)).astype("u4")
        found = np.zeros(1 << 23, "u2")
        flips = [0, *(1 << a for a in range(23))]
        flips += [1 << a | 1 << b for a in range(23) for b in range(a)]
        flips += [1 << a | 1 << b | 1 << c for a in range(23) for b in range(a) for c in range(b)]
        for e in flips:
            found[words ^ np.uint32(e)] = index
        _tables["decoder"] = found
    return _tables["decoder"]


def _near(segment: np.ndarray, bits: int) -> np.ndarray:
    """(n, m) distinct codeword indices of a segment and its one-bit neighbours,
    padded by -1; column 0 is the segment's own."""
    flips = np.array([0, *(1 << b for b in range(bits))], "u4")
    own = decoder()[segment].astype("i4")
    found = np.sort(decoder()[segment[:, None] ^ flips].astype("i4"), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    found[found == own[:, None]] = -1
    found = -np.sort(-found, axis=1)
    width = max(1, int((found >= 0).sum(axis=1).max(initial=0)))
    return np.concatenate([own[:, None], found[:, :width]], axis=1)


def _keys(fps: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, side) of fingerprints; pairs meet across sides 1 and 2, or in 3.
    Two errors leave a segment without any, so they need no keys of all three."""
    u = fps.view("u8")
    cut = [(u >> np.uint64(at) & np.uint64((1 << n) - 1)).astype("u4") for at, n in SEGMENTS]
    near = [_near(s, n) for s, (_, n) in zip(cut, SEGMENTS, strict=True)]
    out = []

    def put(key: np.ndarray, ok: np.ndarray, side: int) -> None:
        row = np.broadcast_to(np.arange(len(u)).reshape(-1, *[1] * (key.ndim - 1)), key.shape)
        out.append((row[ok], key[ok], np.full(int(ok.sum()), side, "i1")))

    for i in range(3):
        for j in range(3):
            if i != j:
                tag = np.int64(8 + 3 * i + j) << 40
                put(tag | cut[i].astype("i8")[:, None] << 12 | near[j], near[j] >= 0, 3)
    if max_bits <= 2:
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))
    a, b, c = (n.astype("i8") for n in near)

    def triple(x, y, z):
        x, y, z = x[:, :, None, None], y[:, None, :, None], z[:, None, None, :]
        return np.int64(1) << 40 | x << 24 | y << 12 | z, (x >= 0) & (y >= 0) & (z >= 0)

    put(*triple(a, b, c), 2)
    own = lambda x: x[:, :1]
    put(*triple(a, own(b), own(c)), 1)
    put(*triple(own(a), b[:, 1:], own(c)), 1)
    put(*triple(own(a), own(b), c[:, 1:]), 1)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect whatever links of up to ``max_bits`` bits connect."""
    fps = np.unique(fps)
    u, links = fps.view("u8"), []
    rest = np.arange(len(u))
    # Breadth first: whatever a linked fingerprint reaches leaves ``rest``.
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            hit = np.bitwise_count(u[rest] ^ u[at]) <= max_bits
            for x in rest[hit]:
                links.append((int(fps[at]), int(fps[x])))
            front += list(rest[hit])
            rest = rest[~hit]
    return links


def links(distinct: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) whose connected
    components are those of all pairs within ``max_bits`` bits (at most four)."""
    if max_bits > MAX_BITS:
        raise ValueError(f"the keys cover up to {MAX_BITS} differing bits")

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy()
            for at in range(0, len(fps), 2_000):
                part = fps[at : at + 2_000]
                row, key, side = _keys(part, max_bits)
                yield pd.DataFrame({"key": key, "fp": part[row], "side": side})

    keys = distinct.select("fp").mapInPandas(keyed, "key long, fp long, side byte")
    of_key = Window.partitionBy("key")
    shared = (
        keys.withColumn("n", F.count("*").over(of_key))
        .withColumn("sides", F.bit_or("side").over(of_key))
        .withColumn("apart", F.min("fp").over(of_key) != F.max("fp").over(of_key))
        .where("apart and sides = 3")
        .withColumn("blocks", F.expr(f"cast((n + {block} - 1) div {block} as int)"))
        .withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    )
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    cells = shared.select("key", "fp", "mine", F.explode(others).alias("other"))
    cells = cells.select("key", "fp", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_forest(cell["fp"].to_numpy(), max_bits), columns=["a", "b"]).astype("int64")

    found = cells.groupBy("key", "lo", "hi").applyInPandas(compare, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of the node's component, for the
    nodes of undirected edges (a, b)."""

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    def star(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        return pairs.join(least.withColumn("m", F.least("u", "m")), "u")

    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = durable(e)
    before = None
    while (now := state(e)) != before:
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = star(large)
        e = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = durable(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text)."""
    fps = durable(fingerprints(docs.select("doc_id", "text")))
    distinct = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct, max_bits))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # Minima are written, so that what meets them under a large component's root
    # comes from a shuffle alone, which Spark may split.
    smallest = durable(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    classes = rooted.join(smallest, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` (doc_id, text, ...) for each component, that of the
    smallest doc_id, null ids last, then of the smallest ``row_key``."""
    fps = fingerprints(docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), "text"))
    distinct = durable(fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("keep")))
    rooted = distinct.join(components(links(distinct, max_bits)), F.col("fp") == F.col("node"), "left")
    return first_rows(docs, rooted.select("keep", F.coalesce("root", "fp").alias("root")))


def row_key(doc_id: Column, text: Column) -> Column:
    """A row's hash of id and text; null and empty differ."""
    return F.xxhash64(doc_id.isNull(), doc_id, text.isNull(), text)


def first_rows(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """One row of ``docs`` for each root of ``rooted`` (root, keep: struct<none,
    doc_id, key>), that of the smallest keep."""
    key = unused(docs, "_key")
    kept = rooted.groupBy("root").agg(F.min("keep").alias("keep")).select(F.col("keep.key").alias(key))
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text")))
    # Rows of one id and text may differ elsewhere: the least hash of the row stays.
    whole = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])
    rows = keyed.join(kept, key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), whole).alias("row"))
    return rows.select("row.*")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
