"""Jaccard self-join of word-shingle sets by signature trees.

Documents link when their sets of shingles have a Jaccard similarity of at least
``share`` hundredths; components of links are found without a row per pair.

Which sets meet: shingles have one order everywhere, rare ones first. Two sets of n
and m shingles that are alike have one in common among the first n - ceil(share * n)
+ 1 and m - ceil(share * m) + 1 of that order. Rarity is a count of all documents in
``BUCKETS`` hashed counters, so passages of many documents come last; it decides
where sets meet, never whether. A set leaves a key of few sets at whose place in the order it has
too few shingles left for any partner there. Keys that the same sets share are one.

How they meet: a key's sets are the leaves of a signature tree. A leaf has a bitmap
of its shingles' hashes, as long as its size asks for; a node the bitmaps of its
children combined by OR, their least and greatest size, and the most shingles that
a bitmap hides (size less bits). The trees of two parts of a key are walked
together, level by level: two nodes have at most the bits that both bitmaps have
and what they hide in common, and part where that is less than the sizes ask for,
or where the sizes are too far apart. Leaves that are left are compared shingle by
shingle. Sets of keys of up to ``FEW`` sets come with counts of their hashes instead, of a quarter of a bitmap's bytes or less: two sets have in common at most what
both have, count by count.

In the first two rounds keys of more than ``BLOCK`` sets meet in blocks, with one set
of the key in all of them, and give a forest of the most similar pairs; in the last
round only keys that still hold several components meet, all their blocks with each
other, and give all pairs between them. So no link between components is lost.

Defined cases: texts are lower-cased A to Z, words are what spaces, tabs, LF, VT, FF
and CR part; fewer words than a shingle are one shingle; null and blank texts have
an empty set, which links with nothing; shingles and sets are known by 64-bit
hashes; equal sets are one set; repeated rows get a row each; a component is named
by its smallest id that is not null; other columns are ignored; texts are read
whole; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import discard, durable, scratch, small_side, written
from .shingles import hashes, shingles
from .simhash import components, row_key

SHINGLE = 4
#: Least similarity in hundredths.
SHARE = 85
#: Counters of rarity: what the driver holds, whatever the corpus.
BUCKETS = 1 << 18
#: Sets of a batch that make a key a frequent one.
OFTEN = 16
#: Sets of a key that meet at once.
BLOCK = 2_048
#: Children of a node.
FAN = 8
#: Sets of a key that meet by counts alone.
FEW = 64
#: Node pairs looked at together, and words of their bitmaps.
WAVE = 1 << 13
WAVE_WORDS = 1 << 21
#: Shingles of the sets of a key that meet at once.
BLOCK_SHINGLES = 1 << 23
#: Similarity beyond the least at which bitmaps make a link all but sure.
SURE = 0.05
#: Sets compared with one other in a task's group.
PARTNERS = 256
#: Links that one task joins to components, before tasks exchange what they found.
LINKS = 1 << 17


def set_id(found: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view("i8"))


def bitmap(found: np.ndarray) -> np.ndarray:
    """Bits of a set's hashes: the least power of two that is four times its size."""
    bits = max(64, 1 << (4 * len(found) - 1).bit_length())
    out = np.zeros(bits, "u1")
    out[(found & np.uint64(bits - 1)).astype("i8")] = 1
    return np.packbits(out, bitorder="little").view("<u8")


def counts(found: np.ndarray) -> np.ndarray:
    """Numbers of a set's hashes in classes of 8 to 16 each, a power of two of them; up
    to 255 are told."""
    classes = max(16, 1 << (len(found) // 16).bit_length())
    return np.minimum(np.bincount((found & np.uint64(classes - 1)).astype("i8"), minlength=classes), 255).astype("u1")


def rarity(docs: DataFrame, text_col: str, shingle: int) -> np.ndarray:
    """A class for each of the hashed counters: half-powers of two over the median of
    all documents' counts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, "i8")
        for batch in batches:
            for text in batch["text"]:
                np.add.at(total, (shingles(text, shingle) & np.uint64(BUCKETS - 1)).astype("i8"), 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    counted = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(BUCKETS, "i8")
    total[counted["bucket"].to_numpy("i8")] = counted["n"].to_numpy("i8")
    middle = max(1.0, float(np.median(total)))
    return np.floor(2 * np.log2(np.maximum(1.0, total / middle))).astype("u1")


def prefix(found: np.ndarray, classes: np.ndarray, share: int) -> np.ndarray:
    """The first shingles of a set, rare ones first, among which an alike one has one."""
    n = len(found)
    size = n + share * n // -100 + 1
    order = np.lexsort((found, classes[(found & np.uint64(len(classes) - 1)).astype("i8")]))
    return found[order[:size]].view("i8")


def _read(docs: DataFrame, text_col: str, id_col: str, shingle: int, share: int) -> DataFrame:
    """(id, key, row, s, n, bits, counts, prefix): the set of every row of ``docs``, its
    bitmap and its counts."""
    classes = docs.sparkSession.sparkContext.broadcast(rarity(docs, text_col, shingle))
    fields = "s long, n long, bits binary, counts binary, prefix array<long>"
    rows = docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("key"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    schema = T.StructType([*rows.schema.fields[:3], *T._parse_datatype_string(fields).fields])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        target = to_arrow_schema(schema)
        for batch in batches:
            found = [np.unique(hashes(t, shingle)) for t in batch.column(3).to_pylist()]
            of = [set_id(f) for f in found], [len(f) for f in found]
            maps = [bitmap(f) for f in found], [counts(f) for f in found]
            first = [prefix(f, classes.value, share) if len(f) else np.zeros(0, "i8") for f in found]
            columns = [*batch.columns[:3], *[pa.array(x, pa.int64()) for x in of], *[pa.array([m.tobytes() for m in x], pa.binary()) for x in maps], pa.array(first, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return rows.mapInArrow(run, schema)


def _frequent(sets: DataFrame) -> DataFrame:
    """(h): keys that ``OFTEN`` sets of some batch share. Sets lie by their hashes, so
    any other key is one of a small share of all sets."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            h, times = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[times >= OFTEN], pa.int64())], ["h"])

    return sets.select("prefix").mapInArrow(run, "h long").distinct()


def _meeting(sets: DataFrame, share: int) -> DataFrame:
    """(h, s, n): the keys of each set at which another one can be alike. Shingles in
    common come at or behind the first key in common, so of a set of n with that key
    at place p no more than n - p are; a set whose size asks for more has no part in
    it; only keys of few sets are cut so, as the keys of many are mostly those of the same
    sets and stay one. Frequent keys keep all their sets, so that none is one task's."""
    keys = sets.select("s", "n", F.posexplode("prefix").alias("p", "h"))
    # The greatest size of a partner.
    keys = keys.select("h", "s", "n", F.expr(f"({100 + share} * (n - p)) div {share} - n").alias("reach"))
    often = small_side(durable(_frequent(sets)), 1_000_000)
    by_size = Window.partitionBy("h").orderBy("n")
    every = by_size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rare = keys.join(often, "h", "left_anti").select(
        "*", F.count("*").over(every).alias("m"), F.min("n").over(every).alias("low"), F.max("reach").over(every).alias("top"), (F.sum("n").over(every) - F.col("n")).alias("other"),
        (F.sum("reach").over(every) - F.col("reach")).alias("its_reach"), F.lag("n").over(by_size).alias("before"), F.lead("n").over(by_size).alias("behind"),
    )
    of_two = "other <= reach and n <= its_reach"
    near = f"coalesce({share} * n <= 100 * before, false) or coalesce({share} * behind <= 100 * n, false)"
    rare = rare.where(f"m > 1 and if(m = 2, {of_two}, (m > {FAN} or (low <= reach and n <= top)) and ({near}))")
    return rare.select("h", "s", "n").union(keys.join(often, "h", "left_semi").select("h", "s", "n"))


class Tree:
    """Nodes of sets with bitmaps of one length: ``levels`` from the leaves up, each
    of (bits, least size, greatest size, most hidden)."""

    def __init__(self, bits: np.ndarray, n: np.ndarray):
        hidden = n - np.bitwise_count(bits).sum(axis=1, dtype="i8")
        self.levels = [(bits, n, n, hidden)]
        while len(self.levels[-1][0]) > FAN:
            bits, low, high, hidden = self.levels[-1]
            at = np.arange(0, len(bits), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(hidden, at)))


class Forest:
    """Components of what a task has linked."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def roots(self, every: np.ndarray) -> np.ndarray:
        distinct, at = np.unique(every, return_inverse=True)
        return np.array([self.root(x) for x in distinct.tolist()], "i8")[at]

    def link(self, a: int, b: int) -> None:
        self.parent[self.root(a)] = self.root(b)


def _able(x: tuple, y: tuple, i: np.ndarray, j: np.ndarray, share: int) -> np.ndarray:
    """Whether something below node i of a level and j of another can be alike."""
    (bits_x, low_x, high_x, hid_x), (bits_y, low_y, high_y, hid_y) = x, y
    able = (share * low_x[i] <= 100 * high_y[j]) & (share * low_y[j] <= 100 * high_x[i])
    at = np.flatnonzero(able)
    both = np.bitwise_count(bits_x[i[at]] & bits_y[j[at]]).sum(axis=1, dtype="i8") + np.minimum(hid_x[i[at]], hid_y[j[at]])
    both = np.minimum(both, np.minimum(high_x[i[at]], high_y[j[at]]))
    able[at] = (100 + share) * both >= share * (low_x[i[at]] + low_y[j[at]])
    return able


def pairs(x: Tree, y: Tree, label: np.ndarray, other: np.ndarray, share: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Leaves (i of x, j of y) of different labels that their bitmaps allow to be
    alike, and the similarity that the bitmaps suggest."""
    words = x.levels[0][0].shape[1]
    wave = min(WAVE, max(1, WAVE_WORDS // words))
    same, top = x is y, min(len(x.levels), len(y.levels)) - 1
    i, j = (a.ravel() for a in np.meshgrid(np.arange(len(x.levels[top][0])), np.arange(len(y.levels[top][0])), indexing="ij"))
    if same:
        i, j = i[i <= j], j[i <= j]
    stack = [(top, i[k : k + wave], j[k : k + wave]) for k in range(0, len(i), wave)]
    while stack:
        level, i, j = stack.pop()
        if not level:
            keep = label[i] != other[j]
            i, j = i[keep], j[keep]
        keep = _able(x.levels[level], y.levels[level], i, j, share)
        i, j = i[keep], j[keep]
        if level:
            step = np.arange(FAN)
            i, j = np.broadcast_arrays((i[:, None] * FAN + step)[:, :, None], (j[:, None] * FAN + step)[:, None, :])
            i, j = i.ravel(), j.ravel()
            keep = (i < len(x.levels[level - 1][0])) & (j < len(y.levels[level - 1][0]))
            if same:
                keep &= i <= j
            i, j = i[keep], j[keep]
            stack += [(level - 1, i[k : k + wave], j[k : k + wave]) for k in range(0, len(i), wave)]
        elif len(i):
            (bits_x, n_x, _, _), (bits_y, n_y, _, _) = x.levels[0], y.levels[0]
            yield i, j, suggested(np.bitwise_count(bits_x[i] | bits_y[j]).sum(axis=1, dtype="i8"), n_x[i] + n_y[j], 64 * words)


def suggested(union: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """The likely similarity of sets whose joint bitmap of ``bits`` has so many bits."""
    size = -bits * np.log1p(-np.minimum(union, bits - 0.5) / bits)
    return sizes / np.maximum(size, 1.0) - 1


def spanning(a: np.ndarray, b: np.ndarray, score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the candidates (a, b) that make a forest of the labels, the most
    similar ones, and the labels of what they join. As links of a similarity hold
    together along the most similar pairs, what is alike is mostly in the forest."""
    order = np.argsort(-score, kind="stable")
    chosen = []
    while len(order):
        of_a, of_b = label[a[order]], label[b[order]]
        keep = of_a != of_b
        order, of_a, of_b = order[keep], of_a[keep], of_b[keep]
        # The best candidate of every label.
        _, first = np.unique(np.stack([of_a, of_b], axis=1).ravel(), return_index=True)
        names = Forest()
        for k in np.unique(first // 2).tolist():
            if names.root(int(of_a[k])) != names.root(int(of_b[k])):
                names.link(int(of_a[k]), int(of_b[k]))
                chosen.append(order[k])
        label = names.roots(label)
    return np.array(chosen, "i8"), label


def _folded(bits: np.ndarray) -> np.ndarray:
    half = bits.shape[1] // 2
    return bits[:, :half] | bits[:, half:]


def _of_few(n: list[int], raw: list[bytes], label: list[int], share: int) -> list[tuple[int, int, float]]:
    """Candidates (i, j, similarity) of sets so few that they are leaves of one node."""
    bits = [(int.from_bytes(r, "little"), 8 * len(r)) for r in raw]
    out = []
    for j in range(len(n)):
        for i in range(j):
            if label[i] == label[j] or share * n[i] > 100 * n[j] or share * n[j] > 100 * n[i]:
                continue
            (x, size), (y, other) = bits[i], bits[j]
            if size > other:
                x, size = (x >> other | x) & ((1 << other) - 1), other
            elif other > size:
                y = (y >> size | y) & ((1 << size) - 1)
            ones, joint = (x.bit_count(), y.bit_count()), (x | y).bit_count()
            both = min(ones[0] + ones[1] - joint + min(n[i] - ones[0], n[j] - ones[1]), n[i], n[j])
            if (100 + share) * both >= share * (n[i] + n[j]):
                out.append((i, j, float(suggested(joint, n[i] + n[j], size))))
    return out


def _by_counts(n: np.ndarray, raw: list[bytes], label: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates (i, j, similarity) of a few sets by their counts. Where hashes differ at
    random, squares of differences of counts add up to as many as differ."""
    i, j = np.triu_indices(len(n), 1) if len(n) > 2 else (np.array([0]), np.array([1]))
    keep = (label[i] != label[j]) & (share * n[i] <= 100 * n[j]) & (share * n[j] <= 100 * n[i])
    i, j, size = i[keep], j[keep], np.array([len(r) for r in raw])
    out = [(i[:0], j[:0], np.zeros(0))]
    least = np.minimum(size[i], size[j])
    for classes in np.unique(least).tolist():
        a, b = i[least == classes], j[least == classes]
        told = np.stack([np.frombuffer(r, "u1").reshape(-1, classes).sum(axis=0, dtype="i4") if len(r) >= classes else np.zeros(classes, "i4") for r in raw])
        # Up to 255 of a joined class count too, or what one set tells the other would hide.
        told = np.minimum(told, 255)
        hidden = n - told.sum(axis=1)
        both = np.minimum(told[a], told[b]).sum(axis=1) + np.minimum(hidden[a], hidden[b])
        able = (100 + share) * np.minimum(both, np.minimum(n[a], n[b])) >= share * (n[a] + n[b])
        a, b = a[able], b[able]
        apart = ((told[a] - told[b]) ** 2).sum(axis=1)
        out.append((a, b, (n[a] + n[b] - apart) / (n[a] + n[b] + apart)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def candidates(n: np.ndarray, raw: list[bytes], label: np.ndarray, share: int, few: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, similarity) of the sets of a cell, which are known by their counts if ``few``,
    else by bitmaps. Trees are of bitmaps of one length;
    lengths differ by one step at most where sizes can be alike."""
    if few:
        return _by_counts(n, raw, label, share)
    if len(n) <= FAN:
        found = _of_few(n.tolist(), raw, label.tolist(), share)
        return tuple(np.array([f[k] for f in found], "f8" if k == 2 else "i8") for k in range(3))
    order = np.argsort(n, kind="stable")
    lengths = np.array([len(raw[k]) for k in order])
    cuts = [0, *(np.flatnonzero(np.diff(lengths)) + 1).tolist(), len(lengths)]
    parts = [(order[lo:hi], np.frombuffer(b"".join(raw[k] for k in order[lo:hi]), "<u8").reshape(hi - lo, -1)) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    out = []
    for k, (at, bits) in enumerate(parts):
        tree = Tree(bits, n[at])
        out += [(at[i], at[j], s) for i, j, s in pairs(tree, tree, label[at], label[at], share)]
        if k + 1 < len(parts) and parts[k + 1][1].shape[1] == 2 * bits.shape[1]:
            to, longer = parts[k + 1]
            out += [(at[i], to[j], s) for i, j, s in pairs(tree, Tree(_folded(longer), n[to]), label[at], label[to], share)]
    empty = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else empty


def _compared(cells: DataFrame, share: int, forest: bool) -> DataFrame:
    """(a, b, h): pairs of sets of different roots that meet in a cell (h, lo, hi, few, s,
    root, n, bits) and may be alike. With ``forest`` the most similar ones that join what may
    be alike, and the keys h, alone, in which further pairs may be."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen, held, found, more = Forest(), None, [], set()

        def of_cell(h: int, few: bool, s: np.ndarray, root: np.ndarray, n: np.ndarray, raw: list[bytes]) -> None:
            label = seen.roots(root) if forest else root
            if forest and (label != root).any():
                more.add(h)
            if (label == label[0]).all():
                return
            i, j, score = candidates(n, raw, label, share, few)
            if forest and len(i):
                chosen, _ = spanning(i, j, score, label)
                if len(chosen) < len(i):
                    more.add(h)
                i, j, score = i[chosen], j[chosen], score[chosen]
                # What is all but sure needs no second link in this task.
                for k in np.flatnonzero(score >= share / 100 + SURE).tolist():
                    seen.link(int(label[i[k]]), int(label[j[k]]))
            if len(i):
                found.append(np.stack([np.minimum(s[i], s[j]), np.maximum(s[i], s[j])], axis=1))

        def of_cells(held, stops: list[int]) -> None:
            h, s, root, n = (held.column(k).to_numpy() for k in ("h", "s", "root", "n"))
            few, raw = held.column("few").to_pylist(), held.column("bits").to_pylist()
            for lo, hi in zip([0, *stops[:-1]], stops, strict=True):
                if hi - lo > 1:
                    of_cell(int(h[lo]), few[lo], s[lo:hi], root[lo:hi], n[lo:hi], raw[lo:hi])

        def done() -> Iterator:
            if found:
                out = np.unique(np.concatenate(found), axis=0)
                found.clear()
                yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1]), pa.nulls(len(out), pa.int64())], ["a", "b", "h"])
            if more:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(more), pa.int64())] * 2 + [pa.array(list(more), pa.int64())], ["a", "b", "h"])
                more.clear()

        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = np.stack([held.column(k).to_numpy() for k in ("h", "lo", "hi")], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            if len(cuts):
                of_cells(held.slice(0, cuts[-1]), cuts.tolist())
                held = held.slice(cuts[-1])
            yield from done()
        if held is not None and held.num_rows > 1:
            of_cells(held, [held.num_rows])
        yield from done()

    key = ["h", "lo", "hi"]
    dealt = cells.repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, "a long, b long, h long").distinct()


def _alike(found: DataFrame, sets: DataFrame, docs: DataFrame, text_col: str, shingle: int, share: int) -> DataFrame:
    """The pairs (a, b) of ``found``, written before, that are alike, shingle by shingle."""
    # Set a meets its partners in blocks; a text is shuffled once for each.
    sizes = found.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("blocks"))
    blocks = found.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"))
    members = blocks.select("a", "block", F.col("b").alias("s")).union(blocks.select("a", "block", F.col("a").alias("s")).distinct())
    members = durable(members.join(sets.select("s", "row"), "s"))
    keyed = docs.select(F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    # While they are few, the texts wanted go to the documents, not all documents to them.
    wanted = small_side(durable(members.select("row").distinct()), 1_000_000)
    texts = keyed.join(wanted, "row", "left_semi").groupBy("row").agg(F.first("text").alias("text"))

    def close(group: pd.DataFrame) -> pd.DataFrame:
        a = int(group["a"].iloc[0])
        mine, out = shingles(group["text"][group["s"] == a].iloc[0], shingle), []
        for b, text in zip(group["s"], group["text"], strict=True):
            if b != a:
                other = shingles(text, shingle)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if 100 * both >= share * (len(mine) + len(other) - both):
                    out.append((a, int(b)))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return durable(texts.join(members, "row").select("a", "block", "s", "text").groupBy("a", "block").applyInPandas(close, "a long, b long"))


def _joined(new: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(node, root) of the components that links ``new`` (a, b) make of those of ``roots``.
    Tasks join the links they hold first, as many tasks as the links ask for; only what
    several tasks hold goes through rounds of shuffles."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
                low, high = sorted((forest.root(a), forest.root(b)))
                forest.parent[high] = forest.parent[low] = low
        nodes = np.fromiter(forest.parent, "i8", len(forest.parent))
        roots = forest.roots(nodes)
        yield pd.DataFrame({"a": nodes[nodes != roots], "b": roots[nodes != roots]})

    links = new if roots is None else new.union(roots.select("node", "root"))
    tasks = max(1, -(-links.count() // LINKS))
    stars = durable(links.coalesce(tasks).mapInPandas(join, "a long, b long"))
    return components(stars) if tasks > 1 else stars.toDF("node", "root")


def _rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return rows.withColumn("root", F.col("s"))
    return rows.join(roots, F.col("s") == F.col("node"), "left").withColumn("root", F.coalesce("root", "s")).drop("node")


def linked(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", *, shingle: int = SHINGLE, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """(id, key, s, n) of every row, written; (node, root) of the sets that have a link."""
    spark = docs.sparkSession
    folder = scratch(spark, "rows")
    read = written(_read(docs, text_col, id_col, shingle, share), "rows", folder)
    # Copies meet in their tasks first.
    of_set = [F.min("row").alias("row"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("counts").alias("counts"), F.first("prefix").alias("prefix")]
    sets = written(read.where("n > 0").groupBy("s").agg(*of_set), "sets")
    rows = written(read.select("id", "key", "s", "n"), "sizes")
    discard(spark, folder)
    kept = durable(_meeting(sets, share))
    # Keys of the same sets are one: their number, joint size and a hash over them tell.
    of_key = kept.groupBy("h").agg(F.count("*").alias("m"), F.sum("n").alias("size"), F.bit_xor(F.xxhash64("s")).alias("x")).where("m > 1")
    chosen = durable(of_key.groupBy("m", "x", "size").agg(F.min("h").alias("h")))
    # Few sets are few pairs: counts must do.
    few = (F.col("m") <= FEW).alias("few")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("long").alias("blocks")
    members = durable(kept.join(chosen.select("h", blocks, few), "h").select("h", "blocks", "few", "s"))
    roots = None
    for forest in (True, True, False):
        rooted = _rooted(members, roots)
        if roots is not None:
            several = rooted.groupBy("h").agg(F.min("root").alias("r"), F.max("root").alias("t")).where("r <> t").select("h")
            rooted = rooted.join(several, "h", "left_semi")
        dealt = rooted.withColumn("mine", F.pmod(F.xxhash64("s"), F.col("blocks")))
        if forest:
            # The set that all blocks of a key hold.
            common = dealt.where("blocks > 1").groupBy("h", "blocks").agg(F.min(F.struct("s", "root")).alias("c"))
            spread = common.select("h", "c.s", "c.root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("mine"), F.lit(False).alias("few"))
            cells = dealt.select("h", "s", "root", "mine", "few").unionByName(spread).distinct().select("h", F.col("mine").alias("lo"), F.col("mine").alias("hi"), "s", "root", "few")
        else:
            other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            cells = other.select("h", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "s", "root", "few")
        met = cells.join(sets.select("s", "n", "bits", "counts"), "s").select("h", "lo", "hi", "few", "s", "root", "n", F.when(F.col("few"), F.col("counts")).otherwise(F.col("bits")).alias("bits"))
        compared = durable(_compared(met, share, forest))
        found = compared.where("h is null").select("a", "b")
        if not found.isEmpty():
            roots = _joined(_alike(found, sets, docs, text_col, shingle, share), roots)
        if forest:
            # Keys of which no pair is left to compare are done.
            rest = members.where("blocks = 1").join(compared.where("h is not null").select("h").distinct(), "h", "left_semi")
            members = durable(rest.unionByName(members.where("blocks > 1")))
            if members.isEmpty():
                break
    return rows, spark.createDataFrame([], "node long, root long") if roots is None else roots


def jaccard_components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", *, shingle: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``: the size of its set
    and the smallest id that links lead to, its own included."""
    rows, roots = linked(docs, text_col, id_col, shingle=shingle, share=share)
    sized = rows.select("id", "s", "n")
    rooted = _rooted(sized.where("n > 0").groupBy("s").agg(F.min("id").alias("least")), roots)
    smallest = durable(rooted.groupBy("root").agg(F.min("least").alias("component")))
    classes = rooted.join(smallest, "root").select("s", "component")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return sized.join(classes, "s", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
