"""Exact top-k by inner product: norm-sorted, SVD-rotated, pruned by bounds.

Components become floor(256 x). All vectors' Gram matrix gives the rotation that
puts most energy into the first coordinates. Candidates are dealt by norm into
bands of descending length and by hash into blocks; every query gets a floor,
its k-th best score among the ``seeds`` longest vectors. A query visits a band
only if its norm times the band's longest may reach its floor; in a block it
takes candidates by descending length, adds the residual bound of Cauchy and
Schwarz to the partial sum over the first coordinates, and computes exact sums
only where the bound reaches the floor, which rises as it goes.

Defined cases: vectors that are null or hold null or non-finite components take
no part; shorter vectors count as padded by zeros; a candidate with the query's
vec_id is the query itself; null ids take no part; copies of a row are one
candidate each; a table without queries gives an empty result. Scores are exact
below 2**53 in floating point, beyond that in whole numbers, held to a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

SCALE = 256.0
SEEDS = 1024
BANDS = 16
BLOCK_ROWS = 32_768
QUERY_ROWS = 4_096
STEP = 1_024
_LONG = 2**63 - 1


def _matrix(cells: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), dtype="<f8").reshape(len(cells), width)


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row-wise inner products as longs."""
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if largest < 2.0**53:
        return np.einsum("ij,ij->i", q, c).astype("int64")
    rows = (sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(q, c, strict=True))
    return np.array([max(-_LONG - 1, min(_LONG, s)) for s in rows], dtype="int64")


def scaled(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, vec as packed doubles, norm) of the vectors that take part, and their width."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = vectors.where("vec_id is not null and embedding is not null").where(finite).select("vec_id", "embedding")
    width = valid.agg(F.max(F.size("embedding"))).first()[0] or 0

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = np.zeros((len(b), width))
            for i, v in enumerate(b["embedding"]):
                m[i, : len(v)] = np.floor(SCALE * np.asarray(v, dtype="float64"))
            yield pd.DataFrame({"vec_id": b["vec_id"], "vec": [r.tobytes() for r in m], "norm": np.sqrt((m * m).sum(axis=1))})

    return durable(valid.mapInPandas(pack, "vec_id long, vec binary, norm double")), width


def rotation(packed: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all rows, by descending singular value, from
    the Gram matrix: width x width sums, whatever the number of rows."""

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for b in batches:
            m = _matrix(b["vec"], width)
            total += m.T @ m
        yield pd.DataFrame({"cell": np.arange(width * width), "x": total.ravel()})

    sums = packed.select("vec").mapInPandas(gram, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x"))
    g = np.zeros(width * width)
    for row in sums.collect():
        g[row.cell] = row.x
    _, vectors = np.linalg.eigh(g.reshape(width, width))
    return np.ascontiguousarray(vectors[:, ::-1])


def _best(qi: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best pairs, by score and then smaller id."""
    order = np.lexsort((ids, -scores, qi))
    q = qi[order]
    first = np.r_[0, np.flatnonzero(np.diff(q)) + 1] if len(q) else np.empty(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return order[rank < k]


def _search(q_ids, q, floors, c_ids, c, turn: np.ndarray, k: int) -> pd.DataFrame:
    """Each query's k best candidates of a block that reach its floor."""
    head = max(1, q.shape[1] // 4)
    order = np.argsort(-np.sqrt((c * c).sum(axis=1)), kind="stable")
    c, c_ids = c[order], c_ids[order]
    qr, cr = q @ turn, c @ turn
    q_rest, c_rest = (np.sqrt((x[:, head:] ** 2).sum(axis=1)) for x in (qr, cr))
    q_norm, c_norm = (np.sqrt((x * x).sum(axis=1)) for x in (q, c))
    floors = floors.astype("float64").copy()
    qi, ci, scores = (np.empty(0, "int64") for _ in range(3))
    for at in range(0, len(c), STEP):
        part = slice(at, at + STEP)
        slack = 1e-9 * q_norm * c_norm[at] + 1e-6
        live = np.flatnonzero(q_norm * c_norm[at] + slack >= floors)
        if not len(live):
            break  # all later candidates are shorter
        bound = qr[live, :head] @ cr[part, :head].T + np.outer(q_rest[live], c_rest[part])
        a, b = np.nonzero((bound + slack[live, None] >= floors[live, None]) & (q_ids[live, None] != c_ids[None, part]))
        a, b = live[a], b + at
        for lo in range(0, len(a), 1 << 18):
            x, y = a[lo : lo + (1 << 18)], b[lo : lo + (1 << 18)]
            qi, ci, scores = np.r_[qi, x], np.r_[ci, y], np.r_[scores, _exact(q[x], c[y])]
            best = _best(qi, c_ids[ci], scores, k)
            qi, ci, scores = qi[best], ci[best], scores[best]
        n = np.bincount(qi, minlength=len(q))
        worst = np.full(len(q), np.inf)
        np.minimum.at(worst, qi, scores)
        floors = np.where(n >= k, np.maximum(floors, worst), floors)
    return pd.DataFrame({"query_id": q_ids[qi], "vec_id": c_ids[ci], "score": scores})


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, *, seeds: int = SEEDS, bands: int = BANDS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows where ``is_query`` (over vec_id)."""
    spark = vectors.sparkSession
    packed, width = scaled(vectors)
    n = packed.count()
    shape = "query_id long, vec_id long, score long"
    empty = spark.createDataFrame([], shape + ", rank int").select("query_id", "rank", "vec_id", "score")
    if not n or not width:
        return empty
    turn = rotation(packed, width)
    cuts = packed.agg(F.percentile_approx("norm", [1 - i / bands for i in range(1, bands)], 10_000)).first()[0]
    band = sum((F.col("norm") < x).cast("int") for x in cuts) if cuts else F.lit(0)
    blocks = max(1, -(-n // (bands * block_rows)))
    dealt = packed.withColumn("band", band).withColumn("block", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(blocks)).cast("int"))
    longest = {r.band: r.longest for r in dealt.groupBy("band").agg(F.max("norm").alias("longest")).collect()}
    top = packed.orderBy(F.desc("norm"), "vec_id").limit(seeds).toPandas()
    seed_ids, seed = top["vec_id"].to_numpy(), _matrix(top["vec"], width)

    def floors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            q = _matrix(b["vec"], width)
            scores = q @ seed.T
            scores[b["vec_id"].to_numpy()[:, None] == seed_ids[None, :]] = -np.inf
            kth = -np.sort(-scores, axis=1)[:, k - 1] if scores.shape[1] >= k else np.full(len(b), -np.inf)
            room = 1e-9 * b["norm"].to_numpy() * (top["norm"].iloc[0] + 1) + 1e-6
            yield b.assign(floor=kth - room)

    queries = durable(packed.where(is_query).mapInPandas(floors, "vec_id long, vec binary, norm double, floor double"))
    q_blocks = max(1, -(-queries.count() // query_rows))
    reach = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(float(x)).alias("longest")) for b, x in longest.items()])
    visits = F.filter(reach, lambda r: F.col("norm") * r["longest"] * (1 + 1e-9) + 1e-6 >= F.col("floor"))
    asked = (
        queries.select("vec_id", "vec", "floor", F.explode(visits).alias("b"), F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int").alias("q"))
        .select("vec_id", "vec", "floor", F.col("b.band").alias("band"), "q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    )
    offered = dealt.select("vec_id", "vec", "band", "block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q"))

    def cell(asked: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or offered.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        q, c = _matrix(asked["vec"], width), _matrix(offered["vec"], width)
        return _search(asked["vec_id"].to_numpy(), q, asked["floor"].to_numpy(), offered["vec_id"].to_numpy(), c, turn, k)

    keys = ["band", "block", "q"]
    found = asked.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInPandas(cell, shape)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
