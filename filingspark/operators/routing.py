"""Tables routed end to end: from the candidates of several engines to a document's tables.

Candidates are (doc_id, engine, engine_ord, table_ord, fallback, page, grid, bbox, page_width, page_height, accuracy):
``grid`` holds rows of texts, ``bbox`` the table's box in units of the page or null, ``accuracy`` is null where an
engine gives none, ``fallback`` marks what an engine's second way found. Choice, overlaps and chains need sizes and
first rows only; they are decided in one fold per document, beside its grids. Boxes of cells are made last, of the
tables that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingspark.operators import tables

# The engines by name; others mean the first.
ENGINES = ("pdfplumber", "camelot")


def _cells(part: Column) -> Column:
    """A part's rows of (text, bbox): a cell's share of the table's box, by page size; null where the table has none.
    ``skip`` rows of the table are left out before them."""
    edge = lambda k, n, of: part["box"][k] + (part["box"][k + 2] - part["box"][k]) * n / of
    x, y = lambda j: edge(0, j, part["n_cols"]), lambda i: edge(1, i + part["skip"], part["height"])
    box = lambda i, j: tables.let(F.array(x(j), y(i), x(j + 1), y(i + 1)), lambda b: tables.normalized_bbox(b, part["page_width"], part["page_height"]))
    boxed = F.coalesce(F.size(part["box"]) >= 4, F.lit(False))
    cell = lambda t, i, j: F.struct(t.alias("text"), F.when(boxed, box(i, j)).alias("bbox"))
    return F.transform(part["grid"], lambda r, i: F.transform(r, lambda t, j: cell(t, i, j)))


def described(candidates: DataFrame) -> DataFrame:
    """Candidates with id, sizes, title, confidence (the engine's accuracy, else the share of numbers), their box as
    given and by page size, and ``grid`` of trimmed texts. Empty grids and those below the least accuracy are left out."""
    kept = candidates.where((F.size("grid") > 0) & (F.col("accuracy").isNull() | (F.col("accuracy") >= tables.MIN_ACCURACY)))
    c = kept.withColumns({"n_rows": F.size("grid"), "n_cols": F.array_max(F.transform("grid", F.size))})
    trimmed = lambda r: F.transform(r, lambda t: F.trim(F.coalesce(t, F.lit(""))))
    return c.select(
        "doc_id", "engine", F.col("engine_ord").cast("int").alias("engine_ord"), F.col("table_ord").cast("int").alias("table_ord"), F.coalesce("fallback", F.lit(False)).alias("fallback"),
        F.col("page").cast("int").alias("page"), F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("_t"), F.col("table_ord").cast("string")).alias("table_id"), "n_rows", "n_cols",
        tables.title_of(F.col("grid")[0]).alias("title"), trimmed(F.col("grid")[0]).alias("header"), F.coalesce(F.bround(F.col("accuracy") / 100, 2), tables.confidence(F.col("grid"))).alias("confidence"),
        F.col("bbox").alias("box"), "page_width", "page_height", tables.normalized_bbox(F.col("bbox"), F.col("page_width"), F.col("page_height")).alias("bbox"), F.transform("grid", trimmed).alias("grid"),
    )


def _kept(found: Column) -> Column:
    """A document's candidates in order, without fallback ones that meet a kept one of their engine on their page with
    a row count at most one off."""
    same = lambda k, x: (k["engine_ord"] == x["engine_ord"]) & (k["page"] == x["page"]) & (F.abs(k["n_rows"] - x["n_rows"]) <= 1)
    step = lambda kept, x: F.when(x["fallback"] & F.exists(kept, lambda k: same(k, x)), kept).otherwise(F.concat(kept, F.array(x)))
    return F.aggregate(found, F.filter(found, lambda x: F.lit(False)), step)


def _best(kept: Column) -> Column:
    """The engine of the most tables, then of the greatest mean confidence (in whole hundredths), then the first."""
    of = lambda e: F.filter(kept, lambda x: x["engine_ord"] == e)
    total = lambda e: F.aggregate(of(e), F.lit(0), lambda s, x: s + x["hundredths"])
    score = lambda e: F.struct(F.size(of(e)).alias("n"), total(e).alias("total"), (-e).alias("minus"))
    return -F.array_max(F.transform(F.array_distinct(F.transform(kept, lambda x: x["engine_ord"])), score))["minus"]


def bases(found: Column, engine: str = "best", merge: bool = True) -> Column:
    """The tables of a document's chosen engine as an array of (engine_ord, table_ord, base_ord), of its candidates in
    order: ``base_ord`` is the table that one continues across pages, or itself. ``engine``: best, a name, or auto for
    the first."""
    mode = engine.lower()
    of_engine = lambda k, e: F.filter(k, lambda x: x["engine_ord"] == e)
    if mode == "best":
        # What a document's fold gives is bound once, not made anew for each table.
        mine = lambda k: tables.let(_best(k), lambda best: of_engine(k, best))
    elif mode in ENGINES:
        mine = lambda k: F.filter(k, lambda x: x["engine"] == mode)
    else:
        mine = lambda k: of_engine(k, 0)
    chained = lambda m: tables.chains(m) if merge else F.transform(m, lambda x: F.struct(x["table_ord"].alias("table_ord"), x["table_ord"].alias("base_ord")))
    chosen = lambda m: F.transform(chained(m), lambda c: F.struct(m[0]["engine_ord"].alias("engine_ord"), c["table_ord"].alias("table_ord"), c["base_ord"].alias("base_ord")))
    return tables.let(tables.let(_kept(found), mine), chosen)


ITEM = ("engine_ord", "table_ord", "engine", "fallback", "page", "n_rows", "n_cols", "title", "header")


def routed(candidates: DataFrame, engine: str = "best", merge: bool = True) -> DataFrame:
    """(doc_id, engine, table_ord, table_id, page, title, n_rows, n_cols, raw_markdown, rows, source_refs): the tables of
    a document's chosen engine, those across pages made one under the first one's id and title. A continuation's header
    row goes; ``source_refs`` cite every part with its own box and confidence."""
    found = described(candidates)
    # A document's candidates are made and dealt once, grids and all; the fold sees sizes and first rows only.
    order = F.struct(*ITEM, F.round(F.col("confidence") * 100).cast("int").alias("hundredths")).alias("item")
    rest = [c for c in found.columns if c not in ("doc_id", *ITEM)]
    t = found.select("doc_id", order, *rest).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("item", *rest))).alias("found"))
    t = t.withColumn("bases", bases(F.col("found")["item"], engine, merge)).select("doc_id", "bases", F.explode("found").alias("f")).select("doc_id", "bases", "f.item.*", *[f"f.{c}" for c in rest])
    own = F.filter("bases", lambda b: (b["engine_ord"] == F.col("engine_ord")) & (b["table_ord"] == F.col("table_ord")))
    part = t.withColumn("base_ord", F.get(own, F.lit(0))["base_ord"]).where("base_ord is not null")
    repeats = (F.col("table_ord") != F.col("base_ord")) & tables.is_header_row(F.col("header"))
    skip = F.coalesce(repeats, F.lit(False)).cast("int").alias("skip")
    ref = F.struct(F.lit("table").alias("ref_type"), "page", "table_id", "bbox", "confidence", "engine")
    part = part.select("*", skip).withColumn("kept", F.slice("grid", F.col("skip") + 1, F.greatest(F.col("n_rows") - F.col("skip"), F.lit(0))))
    piece = F.struct("table_ord", "title", "n_cols", ref.alias("ref"), F.col("kept").alias("grid"), "skip", F.col("n_rows").alias("height"), "box", "page_width", "page_height")
    # A table is of one engine: it is no key, so that documents stay where the join dealt them.
    t = part.groupBy("doc_id", F.col("base_ord").alias("table_ord")).agg(F.array_sort(F.collect_list(piece)).alias("parts"))
    texts = F.flatten(F.transform("parts", lambda p: p["grid"]))
    first = F.col("parts")[0]["ref"]
    return t.select(
        "doc_id", first["engine"].alias("engine"), "table_ord", F.concat(first["table_id"], F.when(F.size("parts") > 1, "_merged").otherwise("")).alias("table_id"), first["page"].alias("page"), F.col("parts")[0]["title"].alias("title"),
        F.aggregate("parts", F.lit(0), lambda n, p: n + F.size(p["grid"])).alias("n_rows"), F.array_max(F.transform("parts", lambda p: p["n_cols"])).alias("n_cols"),
        tables.markdown(texts).alias("raw_markdown"), F.flatten(F.transform("parts", _cells)).alias("rows"), F.transform("parts", lambda p: p["ref"]).alias("source_refs"),
    )


def cells(routed_tables: DataFrame) -> DataFrame:
    """(doc_id, table_ord, table_id, row, col, text, bbox) of routed tables."""
    r = routed_tables.select("doc_id", "table_ord", "table_id", F.posexplode("rows").alias("row", "r"))
    return r.select("doc_id", "table_ord", "table_id", "row", F.posexplode("r").alias("col", "c")).select("doc_id", "table_ord", "table_id", "row", "col", "c.text", "c.bbox")
