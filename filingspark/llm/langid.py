"""Language ID by compression: the language whose dictionary packs a text best.

Every language's raw-content zstandard dictionary is text of a bounded sample:
the ``docs_per_lang`` distinct labelled texts of smallest hash, the first
``sample_chars`` of each from its first letter on, ``dict_bytes`` in all. Predictions read whole texts:
letters only, lower-cased, in chunks, each compressed with every dictionary; the
smallest sum wins, ties go to the smaller language name. The score is the margin
to the runner-up relative to the runner-up's size, 0 to 1; ``accepted`` is false
below ``min_margin``, where the margin is too narrow to rely on.

Defined cases: null text and text without a letter is ``und`` with score 0;
null languages teach nothing; without any labelled text all is ``und``; with one
language the margin is 1; repeated rows get a row each; other columns are kept,
those named like a result are replaced by it; texts of any length are packed
chunk by chunk; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, small_side, unused, without

DOCS_PER_LANG = 400
SAMPLE_CHARS = 4000
DICT_BYTES = 1 << 17
CHUNK_BYTES = 2048
LEVEL = 6
MIN_MARGIN = 0.02
UNKNOWN = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    return _NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""


def train(docs: DataFrame, *, docs_per_lang: int = DOCS_PER_LANG, sample_chars: int = SAMPLE_CHARS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Language to dictionary content, from (text, lang). What reaches the driver
    is bounded by ``docs_per_lang * sample_chars`` per language."""
    labelled = docs.where("lang is not null").where(F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("id"))
    # Copies of a text share a hash, so all counts are of distinct texts.
    counts = labelled.select("lang", "id").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    counts = small_side(durable(counts), 10_000)
    # Only texts of small hash can be among the first; what is shuffled is some
    # four times the sample, however large the table: all texts of a language up
    # to that number, else 1,600 on average by default, with a deviation of 40.
    space = 1 << 30
    cut = F.least(F.lit(float(space)), F.lit(4.0 * docs_per_lang * space) / F.col("n"))
    rank = Window.partitionBy("lang").orderBy("h", "text")
    sample = (
        labelled.withColumn("h", F.pmod(F.col("id"), F.lit(space)))
        .join(counts, "lang")
        .where(F.col("h") < cut)
        .withColumn("text", F.substring(F.regexp_replace("text", r"^\P{L}++", ""), 1, sample_chars))
        .groupBy("lang", "h", "id")
        .agg(F.min("text").alias("text"))
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= docs_per_lang)
        .select("lang", "text")
    )
    texts: dict[str, list[str]] = {}
    for row in sample.collect():
        if found := letters(row.text):
            texts.setdefault(row.lang, []).append(found)
    # The last bytes of a dictionary are the cheapest to refer to.
    return {lang: " ".join(sorted(set(parts), key=len)).encode()[-dict_bytes:] for lang, parts in sorted(texts.items())}


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", *, chunk_bytes: int = CHUNK_BYTES, level: int = LEVEL, min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` without the text, with lang_pred, score and accepted."""

    # Only texts go through Python: other columns stay as they are.
    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zstandard as zstd

        packers = []
        for lang, content in dictionaries.items():
            d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            packers.append((lang, zstd.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False).compress))

        def best(text) -> tuple[str, float]:
            data = letters(text)
            if not packers or not any(map(str.isalpha, data)):
                return UNKNOWN, 0.0
            data = data.encode()
            chunks = [data[i : i + chunk_bytes] for i in range(0, len(data), chunk_bytes)]
            sizes = sorted((sum(len(pack(c)) for c in chunks), lang) for lang, pack in packers)
            second = sizes[1][0] if len(sizes) > 1 else sizes[0][0] * 1e9
            return sizes[0][1], min(1.0, max(0.0, 1 - sizes[0][0] / second))

        for batch in batches:
            found = [best(t) for t in batch]
            yield pd.DataFrame({"lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "accepted": [x[0] != UNKNOWN and x[1] >= min_margin for x in found]})

    docs = without(docs, *({"lang_pred", "score", "accepted"} - {text_col}))
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    found = unused(docs, "judged")
    return docs.select(*kept, judged(F.col(text_col)).alias(found)).select(*kept, f"{found}.*")
