"""Quality rules (native): counting rules and a hashed n-gram likelihood ratio.

Features of a text are its words and the pairs of neighbouring words, hashed into
``buckets``. The trusted target (documents labelled good) and the raw corpus (all
documents) give a multinomial over the buckets each; a document's score is the
log-likelihood ratio of its features, divided by their number, and the document
is kept if the score reaches ``threshold``, without any sampling.
Bucket ratios are shrunk to 1 by ``prior`` pseudo-counts, so that features which
were rarely seen say little. The model has ``buckets`` numbers whatever the
corpus, and reaches the rows as a scalar subquery. The raw corpus is counted
whole; the trusted target is at most ``target_docs`` labelled documents, those
of smallest id hash, so that their ids can be broadcast and no text is shuffled.

Defined cases: null text has no words and fails the base rules; without any
labelled document every ratio is 1 and the base rules decide; repeated rows
count each; labels for unknown documents and null labels are ignored; other
columns are kept, those named like a result are replaced by it; texts may be of
any length that a row holds; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, let, unused, without, words

BUCKETS = 1 << 16
PRIOR = 20.0
TARGET_DOCS = 1 << 16
THRESHOLD = -0.15
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _features(w: Column, buckets: int) -> Column:
    """Buckets of the words, and of each word with the next one."""
    of = lambda *x: F.pmod(F.xxhash64(*x), F.lit(buckets)).cast("int")
    return F.concat(F.transform(w, lambda x: of(x)), F.transform(w, lambda x, i: of(x, F.get(w, i + 1))))


def _repeated_words(w: Column) -> Column:
    """Positions covered by windows of five words that occur at least twice.

    A window's hash and position share one long, so that sorting puts equal
    windows side by side; neighbours are compared by their words as well.
    """
    n = F.size(w) - (WINDOW - 1)

    def repeated(v):
        words_, h, shift = v["w"], v["h"], v["shift"]
        packed = F.sort_array(F.transform(h, lambda x, i: F.call_function("shiftleft", x, shift).bitwiseOR(i.cast("long"))))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1

        def same(a, b):
            ia, ib = a.bitwiseAND(mask).cast("int"), b.bitwiseAND(mask).cast("int")
            equal_hash = F.call_function("shiftright", a, shift) == F.call_function("shiftright", b, shift)
            return equal_hash & (F.slice(words_, ia + 1, WINDOW) == F.slice(words_, ib + 1, WINDOW))

        found = let(
            packed,
            lambda s: F.filter(
                s,
                lambda x, i: F.when((i > 0) & same(x, F.get(s, F.greatest(i - 1, F.lit(0)))), True)
                .when((i + 1 < F.size(s)) & same(x, F.get(s, F.least(i + 1, F.size(s) - 1))), True)
                .otherwise(False),
            ),
        )
        starts = F.sort_array(F.transform(found, lambda x: x.bitwiseAND(mask)))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).cast("long").alias("last")),
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW).cast("long"), p - acc["last"])).alias("n"), p.alias("last")),
            lambda acc: acc["n"],
        )

    hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    shift = F.length(F.bin(n.cast("long"))).cast("int")
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(F.struct(w.alias("w"), h.alias("h"), shift.alias("shift")), repeated)))
    return F.when(n < 2, F.lit(0).cast("long")).otherwise(some)


def base_rules(docs: DataFrame, text_col: str = "text", words_col: str = "_words") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, and ``words_col``: the words."""
    docs = without(docs, *({*BASE, words_col} - {text_col}))
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.withColumn(words_col, words(F.col(text_col))).select(
        "*",
        F.size(words_col).cast("long").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(F.col(words_col), _repeated_words).alias("n_repeat_words"),
    )
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def ratio_model(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR, target_docs: int = TARGET_DOCS) -> DataFrame:
    """One row: ``llr``, the bucket log-ratios of trusted target to raw corpus."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_good")).distinct()
    good = good.orderBy(F.xxhash64("_good"), "_good").limit(target_docs)
    marked = docs.select("doc_id", "text").join(F.broadcast(good), F.col("doc_id") == F.col("_good"), "left")
    counts = (
        marked.select(F.col("_good").isNotNull().cast("int").alias("t"), F.explode(let(words(F.col("text")), lambda w: _features(w, buckets))).alias("b"))
        .groupBy("b", "t")
        .agg(F.count("*").alias("n"))
        .groupBy("b")
        .agg(F.sum("n").cast("double").alias("raw"), F.sum(F.col("n") * F.col("t")).cast("double").alias("target"))
    )
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").fillna(0.0)
    rows = F.array_sort(F.collect_list(F.struct("b", "raw", "target")))
    model = every.agg(rows.alias("rows"), F.try_divide(F.sum("target"), F.sum("raw")).alias("share"))

    def ratios(m):
        share = m["share"]
        ratio = lambda x: F.log((x["target"] + prior * share) / ((x["raw"] + prior) * share))
        return F.transform(m["rows"], lambda x: F.when(share > 0, ratio(x)).otherwise(0.0))

    return model.select(let(F.struct("rows", "share"), ratios).alias("llr"))


def quality(docs: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS, prior: float = PRIOR, threshold: float = THRESHOLD, target_docs: int = TARGET_DOCS) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``llr`` (mean log ratio of
    a feature, 0 without words) and ``kept``."""
    model = durable(ratio_model(docs, labels, buckets, prior, target_docs))
    docs = without(docs, *BASE, "llr", "kept")
    words_col, model_col = unused(docs, "_words"), unused(docs, "_model")
    scored = base_rules(docs, words_col=words_col).withColumn(model_col, model.scalar())
    both = F.struct(F.col(model_col).alias("r"), F.col(words_col).alias("w"))
    total = let(both, lambda s: F.aggregate(_features(s["w"], buckets), F.lit(0.0), lambda acc, b: acc + F.get(s["r"], b)))
    scored = scored.withColumn("llr", F.when(F.col("n_words") > 0, total / (2 * F.col("n_words"))).otherwise(0.0))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)).drop(words_col, model_col)
