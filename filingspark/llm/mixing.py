"""Mixing sources to target weights (native).

The words of a source form one stream, packed into blocks of ``block_words``.
Targets are word counts by weight, capped at ``cap`` times a source and reshared
(water filling). Every output shard, the last short one too, draws the source of
each of its slots, a multinomial draw by target share; a source's slots, numbered over the shards,
go through a pseudorandom permutation of its block indices, one for each pass
over the source; blocks are then joined by (source, index).

Independent draws miss the targets by their square root, so what a source drew
over its quota of slots is cut and what it lacks goes to a closing shard; its
last slot ends at the word that meets the target. Passes before the last take
every block once, so no document is taken more than ``cap`` times.

Prefix sums never put a source into one task: documents are numbered within
(source, hash group) and groups, whose number grows with the rows, within a
source. What reaches every task is two numbers a source.

Defined cases: null text has size 0, null source is a source of its own and
comes last; documents of size 0 are never taken; repeated rows count each;
an empty table gives an empty result; long texts take part in many blocks; other
columns are ignored, and kept by ``mixed_texts``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, let, small_side, words

BLOCK_WORDS = 512
SHARD_SLOTS = 4096
GROUPS = 1024
GROUP_ROWS = 1 << 16
CAP = 3
WEIGHTS = (5.0, 2.0, 1.0)
SEED = 20240
#: Odd multipliers under 2**22, so that products of 41-bit numbers fit a long.
MULTIPLIERS = (2654435, 3266489, 2246822, 3168471)


def _bijection(x: Column, bits: Column, keys: list[Column]) -> Column:
    """A permutation of [0, 2**bits): odd multiply, add, fold high bits down."""
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - F.lit(1)
    half = ((bits + 1) / 2).cast("int")
    for m, key in zip(MULTIPLIERS, keys, strict=True):
        x = (x * F.lit(m | 1) + key).bitwiseAND(mask)
        x = let(x, lambda v: v.bitwiseXOR(F.call_function("shiftrightunsigned", v, half)))
    return x


def permuted(i: Column, n: Column, *seed: Column) -> Column:
    """Place of ``i`` in a pseudorandom permutation of [0, n), n up to 2**41.

    A permutation of the next power of two, walked until it falls below ``n``.
    """
    bits = F.length(F.bin(F.greatest(n - 1, F.lit(1)))).cast("int")
    size = F.call_function("shiftleft", F.lit(1).cast("long"), bits)
    keys = F.array(*[F.pmod(F.xxhash64(*seed, F.lit(SEED + k)), size) for k in range(4)])

    def body(s):
        step = lambda x: _bijection(x, s["bits"], [s["keys"][k] for k in range(4)])
        walk = F.aggregate(
            F.sequence(F.lit(1), F.lit(64)),
            step(s["i"]),
            lambda x, _: F.when(x < s["n"], x).otherwise(step(x)),
        )
        return let(walk, lambda x: F.when(x < s["n"], x).otherwise(F.raise_error(F.lit("permutation walk too long")).cast("long")))

    return let(F.struct(i.cast("long").alias("i"), n.cast("long").alias("n"), bits.alias("bits"), keys.alias("keys")), body)


def source_targets(groups: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, sid, source_size, weight, target) from (source, words) sums.

    One row per source enters the only unpartitioned windows here.
    """
    sizes = groups.groupBy("source").agg(F.sum("words").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sizes = sizes.withColumn("sid", F.row_number().over(order) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sizes = sizes.withColumn("weight", F.element_at(cycle, (F.col("sid") % len(weights) + 1).cast("int")))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    ) / F.sum("weight").over(after)
    return (
        sizes.withColumn("level", level)
        .withColumn("target", F.least(F.max("level").over(everything) * F.col("weight"), (cap * F.col("source_size")).cast("double")))
        .withColumn("target", F.greatest(F.col("target"), F.lit(0.0)))
        .drop("level")
    )


def draws(sources: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(sid, shard, n): how many slots of each shard fall to a source, by one draw
    a slot in proportion to quotas (sid, quota, upto: their running sum)."""
    bounds = sources.agg(F.array_sort(F.collect_list(F.struct("upto", "sid"))).alias("b"), F.coalesce(F.sum("quota"), F.lit(0)).alias("n"))
    bounds = bounds.select(F.transform("b", lambda x: x["upto"]).alias("upto"), F.transform("b", lambda x: x["sid"]).alias("sids"), "n")
    shards = bounds.where("n > 0").select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {shard_slots}"))).alias("shard"))
    slots = F.sequence(F.lit(0), (F.least(F.lit(shard_slots), F.col("n") - F.col("shard") * shard_slots) - 1).cast("int"))
    each = shards.repartition("shard").select("shard", "n", F.explode(slots).alias("slot"))
    each = each.withColumn("u", F.pmod(F.xxhash64("shard", "slot", F.lit(SEED)), F.col("n")))
    each = each.withColumn("upto", bounds.select("upto").scalar()).withColumn("sids", bounds.select("sids").scalar())
    # The number of running sums up to u, by halving steps.
    steps = F.transform(F.sequence(F.length(F.bin(F.size("upto").cast("long"))) - 1, F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    below = F.aggregate(steps, F.lit(0), lambda lo, p: F.when((lo + p <= F.size("upto")) & (F.get("upto", lo + p - 1) <= F.col("u")), lo + p).otherwise(lo))
    return each.withColumn("sid", F.get("sids", below)).groupBy("sid", "shard").agg(F.count("*").alias("n"))


def _slots(sources: DataFrame, block_words: int, shard_slots: int) -> DataFrame:
    """(sid, block, epoch, take): the drawn slots and the words each takes."""
    b = F.lit(block_words)
    goal = F.round("target").cast("long")
    s = (
        sources.where("source_size > 0")
        .withColumn("n_blocks", F.expr(f"(source_size + {block_words} - 1) div {block_words}"))
        .withColumn("epochs", F.expr("cast(round(target) as long) div source_size"))
        .withColumn("rest", goal - F.col("epochs") * F.col("source_size"))
        .withColumn("tail", F.col("source_size") - (F.col("n_blocks") - 1) * b)
        .withColumn("last_slots", F.when(F.col("rest") > 0, F.least(F.col("n_blocks"), F.expr(f"(rest + {block_words} - 1) div {block_words} + 1"))).otherwise(0))
        .withColumn("quota", F.col("epochs") * F.col("n_blocks") + F.col("last_slots"))
        .withColumn("upto", F.sum("quota").over(Window.orderBy("sid")))
    )
    s = durable(s.select("sid", "source_size", "n_blocks", "epochs", "rest", "tail", "quota", "upto"))
    counts = draws(s, shard_slots)
    counts = counts.withColumn("offset", F.sum("n").over(Window.partitionBy("sid").orderBy("shard")) - F.col("n"))
    drawn = counts.groupBy("sid").agg(F.sum("n").alias("drawn"))
    few = small_side(s, 100_000)
    trimmed = counts.join(few, "sid").select("sid", "offset", F.least(F.col("n"), F.col("quota") - F.col("offset")).alias("n"))
    closing = s.join(drawn, "sid", "left").select("sid", F.coalesce("drawn", F.lit(0)).alias("offset"), (F.col("quota") - F.coalesce("drawn", F.lit(0))).alias("n"))
    slots = (
        trimmed.unionByName(closing)
        .where("n > 0")
        .select("sid", F.explode(F.sequence("offset", F.expr("offset + n - 1"))).alias("j"))
        .join(few, "sid")
        .withColumn("epoch", F.expr("j div n_blocks"))
        .withColumn("i", F.expr("j % n_blocks"))
    )
    slots = durable(slots.withColumn("block", permuted(F.col("i"), F.col("n_blocks"), F.col("sid"), F.col("epoch"))).drop("j", "quota", "upto"))
    # Where the last pass meets the short block: slots behind it begin earlier.
    short = slots.where("epoch = epochs and block = n_blocks - 1").select("sid", F.col("i").alias("short_i"))
    full = F.when(F.col("block") == F.col("n_blocks") - 1, F.col("tail")).otherwise(b)
    before = F.col("i") * b - F.when(F.col("short_i") < F.col("i"), b - F.col("tail")).otherwise(0)
    return (
        slots.join(small_side(durable(short), 100_000), "sid", "left")
        .withColumn("take", F.when(F.col("epoch") < F.col("epochs"), full).otherwise(F.least(full, F.col("rest") - before)))
        .where("take > 0")
        .select("sid", "block", "epoch", "take")
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    weights=WEIGHTS,
    cap: float = CAP,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    groups: int | None = None,
) -> DataFrame:
    """One row per document: id, ``key`` (hash of id and text), ``copy`` (number
    among the rows of equal source, id and key, from 1), source, size,
    source_size, target, taken, and ``pieces``, the word ranges [lo, hi) that the
    mix takes in each pass (epoch)."""
    sized = durable(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.xxhash64(id_col, text_col).alias("key"),
            F.size(words(F.col(text_col))).cast("long").alias("size"),
        )
    )
    groups = groups or max(GROUPS, sized.count() // GROUP_ROWS)
    sized = sized.withColumn("grp", F.pmod("key", F.lit(groups)))
    sums = sized.groupBy("source", "grp").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("group_start", F.sum("words").over(Window.partitionBy("source").orderBy("grp")) - F.col("words"))
    sums = durable(sums)
    sources = durable(source_targets(sums, weights, cap))
    few = small_side(sources, 100_000)
    sums = sums.join(few, sums["source"].eqNullSafe(few["source"])).select(
        sums["source"].alias("g_source"), sums["grp"].alias("g_grp"), "group_start", "sid", "source_size", "target"
    )
    inside = Window.partitionBy("source", "grp").orderBy("doc_id", "key")
    placed = (
        sized.withColumn("rn", F.row_number().over(inside))
        .withColumn("copy", F.col("rn") - F.rank().over(inside) + 1)
        .withColumn("inner", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(sums, F.col("source").eqNullSafe(F.col("g_source")) & (F.col("grp") == F.col("g_grp")))
        .withColumn("start", F.col("group_start") + F.col("inner"))
    )
    keep = ["sid", "grp", "rn", "doc_id", "key", "copy", "source", "size", "source_size", "target", "start"]
    placed = placed.select(*keep)
    spans = F.when(F.col("size") > 0, F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})"))
    parts = placed.select(*keep, F.explode_outer(spans).alias("block"))
    slots = _slots(sources, block_words, shard_slots)
    lo = F.greatest(F.col("start"), F.col("block") * block_words)
    hi = F.least(F.col("start") + F.col("size"), F.col("block") * block_words + F.col("take"))
    meets = F.col("take").isNotNull() & (hi > lo)  # least() skips nulls
    piece = F.when(meets, F.struct("epoch", (lo - F.col("start")).alias("lo"), (hi - F.col("start")).alias("hi")))
    return (
        parts.join(slots, ["sid", "block"], "left")
        .groupBy(*keep)
        .agg(
            F.coalesce(F.sum(F.when(meets, hi - lo)), F.lit(0)).cast("long").alias("taken"),
            F.array_sort(F.collect_list(piece)).alias("pieces"),
        )
        .drop("sid", "grp", "rn", "start")
    )


def mixed_texts(docs: DataFrame, **parameters) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row for each document and
    pass that takes words of it. A pass that takes all words keeps the text as it
    is, else the taken words are joined by spaces; n_chars follows the text."""
    mixed = mix_sources(docs, **parameters)
    passes = (
        mixed.select("source", "doc_id", "key", "copy", "size", F.explode("pieces").alias("p"))
        .groupBy("source", "doc_id", "key", "copy", "size", "p.epoch")
        .agg(F.array_sort(F.collect_list(F.struct("p.lo", "p.hi"))).alias("ranges"))
    )
    whole = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["hi"] - r["lo"]) >= F.col("size")
    # Rows travel as one column, so that no name of theirs can clash.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, "doc_id", "source", "text", F.xxhash64("doc_id", "text").alias("key"))
    same = Window.partitionBy("source", "doc_id", "key").orderBy(F.xxhash64("row"))
    keyed = keyed.withColumn("copy", F.row_number().over(same)).alias("d")
    passes = passes.select("source", "doc_id", "key", "copy", "ranges", whole.alias("whole")).alias("p")
    equal = [F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("source", "doc_id")] + [F.col(f"d.{c}") == F.col(f"p.{c}") for c in ("key", "copy")]
    joined = keyed.join(passes, equal).select("row", "text", "ranges", "whole")
    cut = let(words(F.col("text")), lambda w: F.array_join(F.flatten(F.transform("ranges", lambda r: F.slice(w, (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")))), " "))
    joined = joined.select("row", F.when(F.col("whole"), F.col("text")).otherwise(cut).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return joined.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
