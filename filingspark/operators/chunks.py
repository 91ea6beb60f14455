"""Sections and chunks of page text: ordered folds per document.

The folds see a page's length and headings, not its text; pages get the number
of their group and their text is joined by it afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingspark.functions import text

GROUP_CHARS = 1500
CHUNK_CHARS = 1200
_OUT = "array<struct<page:int,grp:int>>"
_DONE = "array<struct<grp:int,page_start:int,page_end:int,section:string>>"


def sections(pages: DataFrame) -> DataFrame:
    """(doc_id, grp, page_start, page_end, section, text): a heading page closes
    the group before it (which then ends on that page's number), a group that
    would exceed 1500 characters closes on the page before."""
    lines = F.transform(F.split("text", r"\r\n|\r|\n"), F.trim)
    heads = F.filter(lines, text.is_heading)
    item = F.struct(F.col("page_number").alias("page"), F.length("text").alias("len"), (F.trim(F.regexp_replace("text", r"\s", " ")) == "").alias("blank"), F.get(heads, F.size(heads) - 1).alias("head"))
    zero = F.struct(F.lit(0).alias("grp"), F.lit(1).alias("start"), F.lit(0).alias("len"), F.lit(True).alias("blank"), F.lit(None).cast("string").alias("section"), F.array().cast(_OUT).alias("out"), F.array().cast(_DONE).alias("done"))

    def group(acc, end, section):
        return F.array(F.struct(acc["grp"].alias("grp"), acc["start"].alias("page_start"), end.alias("page_end"), section.alias("section")))

    def step(acc, p):
        closes = p["head"].isNotNull() & ~acc["blank"]
        section = F.coalesce(p["head"], acc["section"])
        length = F.when(closes, 0).otherwise(acc["len"])
        full = (length + p["len"] > GROUP_CHARS) & (length > 0)
        cut = closes | full
        grp = acc["grp"] + cut.cast("int")
        done = F.when(closes, F.concat(acc["done"], group(acc, p["page"], acc["section"]))).when(full & ~acc["blank"], F.concat(acc["done"], group(acc, p["page"] - 1, section))).otherwise(acc["done"])
        return F.struct(
            grp.alias("grp"), F.when(cut, p["page"]).otherwise(acc["start"]).alias("start"),
            (F.when(cut, 0).otherwise(acc["len"]) + p["len"] + 1).alias("len"), (F.when(cut, True).otherwise(acc["blank"]) & p["blank"]).alias("blank"), section.alias("section"),
            F.concat(acc["out"], F.array(F.struct(p["page"].alias("page"), grp.alias("grp")))).alias("out"), done.alias("done"),
        )

    def finish(acc):
        last = F.element_at(acc["out"], -1)["page"]
        return F.struct(acc["out"].alias("out"), F.when(acc["blank"], acc["done"]).otherwise(F.concat(acc["done"], group(acc, last, acc["section"]))).alias("done"))

    folded = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("p")).select("doc_id", F.aggregate("p", zero, step, finish).alias("f"))
    of_page = folded.select("doc_id", F.explode("f.out").alias("o")).select("doc_id", F.col("o.page").alias("page_number"), F.col("o.grp").alias("grp"))
    texts = pages.join(of_page, ["doc_id", "page_number"]).groupBy("doc_id", "grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return folded.select("doc_id", F.explode("f.done").alias("g")).select("doc_id", "g.*").join(texts, ["doc_id", "grp"])


def split_long(paragraph: Column, size: int = CHUNK_CHARS) -> Column:
    """Sentences packed up to ``size``; only the last rest is cut hard."""
    zero = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("now"))

    def step(acc, s):
        over = (F.length(acc["now"]) + F.length(s) > size) & (acc["now"] != "")
        return F.struct(F.when(over, F.concat(acc["parts"], F.array(acc["now"]))).otherwise(acc["parts"]).alias("parts"), F.when(over, s).otherwise(F.concat(acc["now"], s)).alias("now"))

    def finish(acc):
        cuts = F.transform(F.sequence(F.lit(0), F.floor((F.length(acc["now"]) - 1) / size).cast("int")), lambda k: F.substring(acc["now"], k * size + 1, size))
        return F.when(acc["now"] == "", acc["parts"]).otherwise(F.concat(acc["parts"], cuts))

    return F.aggregate(F.split(paragraph, r"(?<=[。！？.!?\n])"), zero, step, finish)


def split_text(body: Column, size: int = CHUNK_CHARS) -> Column:
    """Paragraphs packed up to ``size`` characters, long ones by sentences."""
    zero = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("now"))

    def step(acc, p):
        flushed = F.when(acc["now"] != "", F.concat(acc["parts"], F.array(acc["now"]))).otherwise(acc["parts"])
        joined = F.when(acc["now"] == "", p).otherwise(F.trim(F.concat(acc["now"], F.lit("\n\n"), p)))
        over = (F.length(joined) > size) & (acc["now"] != "")
        return (
            F.when(F.length(p) > size, F.struct(F.concat(flushed, split_long(p, size)).alias("parts"), F.lit("").alias("now")))
            .when(over, F.struct(flushed.alias("parts"), p.alias("now")))
            .otherwise(F.struct(acc["parts"].alias("parts"), joined.alias("now")))
        )

    packed = F.aggregate(F.split(body, "\n\n"), zero, step, lambda acc: F.when(acc["now"] != "", F.concat(acc["parts"], F.array(acc["now"]))).otherwise(acc["parts"]))
    return F.when(F.length(body) <= size, F.array(body)).otherwise(packed)


def chunks(pages: DataFrame) -> DataFrame:
    """(doc_id, chunk_ord, chunk_id, page_start, page_end, section, text, quote)."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    s = sections(pages).withColumn("body", strip(F.col("text")))
    c = s.select("doc_id", "grp", "page_start", "page_end", "section", F.posexplode(split_text(F.col("body"))).alias("part", "piece")).withColumn("piece", strip(F.col("piece"))).where("piece <> ''")
    # A document's groups and a group's parts may be any number.
    order = F.col("grp").cast("long") * (1 << 31) + F.col("part")
    return c.select("doc_id", order.alias("chunk_ord"), F.sha1(F.concat_ws("|", F.col("doc_id").cast("string"), order.cast("string"))).alias("chunk_id"), "page_start", "page_end", "section", F.col("piece").alias("text"), text.quote(F.col("piece")).alias("quote"))
