"""Tables as cell rows: grids, headers, confidence, merging across pages.

Cells are (doc_id, table_ord, row, col, text); a table's rows are gathered per
table, whose size a page bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingspark.functions.numbers import FLOAT
from filingspark.functions.text import let

# Marks around numbers, and words of a statement's title.
LEAD_MARKS, TAIL_MARKS = r"^[$¥￥€£＄△▲\-－(（]+", r"[)）%％万元亿]+$"
#: A cell that is a number once marks are gone, in one pass.
NUMBER = rf"{LEAD_MARKS[:-1]}*(?:{FLOAT[1:-1]}{TAIL_MARKS[:-2]}*$|(?i:nan|inf|infinity){TAIL_MARKS[:-2]}*\z)"
TITLE_WORDS = ("资产负债表", "利润表", "现金流量表", "合并", "balance sheet", "income statement", "cash flow", "profit", "statement of")
MIN_ACCURACY = 10.0


def is_number(cell: Column) -> Column:
    # Replacing looks for a mark first; translating makes every character anew.
    return F.replace(F.replace(cell, F.lit(","), F.lit("")), F.lit(" "), F.lit("")).rlike(NUMBER)


def _filled(row: Column) -> Column:
    return F.filter(F.transform(row, lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != "")


def is_header_row(row: Column) -> Column:
    """Whether less than half of a row's filled cells are numbers."""
    return let(_filled(row), lambda filled: (F.size(filled) > 0) & (F.size(F.filter(filled, is_number)) < F.size(filled) / 2))


def title_of(first_row: Column) -> Column:
    """The first row's only cell, or its first one if it names a statement."""

    def of(filled):
        first = F.get(filled, 0)
        return F.when((F.size(filled) == 1) & (F.length(first) > 2), first).when((F.size(filled) > 0) & let(F.lower(first), named), first)

    def named(low):
        found = F.lit(False)
        for w in TITLE_WORDS:
            found = found | low.contains(w)
        return found

    return let(_filled(first_row), of)


def confidence(grid: Column) -> Column:
    """0.55 to 0.95 by the share of numeric cells, half-even to two places."""
    share = lambda cells: F.size(F.filter(cells, is_number)) / F.size(cells)
    sure = lambda cells: F.when(F.size(cells) == 0, 0.5).otherwise(F.bround(F.least(0.55 + share(cells) * 0.4, F.lit(0.95)), 2))
    return F.when(F.size(grid) == 0, 0.0).otherwise(let(F.filter(F.flatten(grid), lambda c: c.isNotNull()), sure))


def markdown(grid: Column) -> Column:
    """A grid as a Markdown table; its width and its lines are made once."""
    cells = lambda r, w: F.transform(F.concat(r, F.array_repeat(F.lit(""), (w - F.size(r)).cast("int"))), lambda c: F.trim(F.coalesce(c, F.lit(""))))
    line = lambda r, w: F.concat(F.lit("| "), F.array_join(cells(r, w), " | "), F.lit(" |"))
    rule = lambda w: F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), w.cast("int")), " | "), F.lit(" |"))
    joined = lambda lines, w: F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule(w)), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")
    said = lambda g: let(F.array_max(F.transform(g, F.size)), lambda w: let(F.transform(g, lambda r: line(r, w)), lambda lines: joined(lines, w)))
    return F.when(F.size(grid) == 0, "").otherwise(let(grid, said))


def _laid(cells: Column) -> Column:
    """Rows of texts, ``n_rows`` by ``n_cols``, of an array of (row, col, text): sorted, with a blank one for every
    place; each place's last one stays."""
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    blank = F.flatten(F.transform(upto(F.col("n_rows")), lambda r: F.transform(upto(F.col("n_cols")), lambda c: F.struct(r.alias("row"), c.alias("col"), F.lit("").alias("text")))))
    same = lambda a, b: (a["row"] == b["row"]) & (a["col"] == b["col"])
    last = lambda s: F.filter(s, lambda x, i: ~F.coalesce(same(x, F.get(s, i + 1)), F.lit(False)))
    rows = lambda k: F.transform(upto(F.col("n_rows")), lambda r: F.transform(F.slice(k, r * F.col("n_cols") + 1, F.col("n_cols")), lambda x: x["text"]))
    return let(let(F.sort_array(F.concat(cells, blank)), last), rows)


def grids(cells: DataFrame) -> DataFrame:
    """(doc_id, table_ord, n_rows, n_cols, grid): dense, empty cells as ''; of
    several texts for one place the greatest. A table's cells are gathered once."""
    cell = F.struct("row", "col", F.coalesce("text", F.lit("")).alias("text"))
    t = cells.where("row >= 0 and col >= 0").groupBy("doc_id", "table_ord").agg(F.collect_list(cell).alias("c"), (F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"))
    return t.select("doc_id", "table_ord", "n_rows", "n_cols", _laid(F.col("c")).alias("grid"))


def row_grids(rows: DataFrame) -> DataFrame:
    """What ``grids`` gives, of rows (doc_id, table_ord, row, texts) that hold their cells from column 0 on. A table
    whose rows are all there, once and equally wide, is its rows in order; others are laid cell by cell."""
    if rows.schema["texts"].dataType.containsNull:
        rows = rows.withColumn("texts", F.transform("texts", lambda x: F.coalesce(x, F.lit(""))))
    kept, wide = rows.where("row >= 0 and size(texts) > 0"), F.size("texts")
    t = kept.groupBy("doc_id", "table_ord").agg(F.sort_array(F.collect_list(F.struct("row", "texts"))).alias("r"), (F.max("row") + 1).alias("n_rows"), F.max(wide).alias("n_cols"), F.min(wide).alias("least"))
    whole = (F.size("r") == F.col("n_rows")) & (F.col("least") == F.col("n_cols")) & (F.size(F.array_distinct(F.col("r")["row"])) == F.col("n_rows"))
    cells = F.flatten(F.transform("r", lambda x: F.transform(x["texts"], lambda c, j: F.struct(x["row"].alias("row"), j.alias("col"), c.alias("text")))))
    return t.select("doc_id", "table_ord", "n_rows", "n_cols", F.when(whole, F.col("r")["texts"]).otherwise(_laid(cells)).alias("grid"))


def plain_text(grid: Column) -> Column:
    return F.array_join(F.transform(grid, lambda r: F.array_join(r, " | ")), "\n")


def stats(cells: DataFrame) -> DataFrame:
    """Rows, columns and cells of a table, with spans (default 1)."""
    span = lambda c: F.coalesce(F.col(c), F.lit(1)) if c in cells.columns else F.lit(1)
    return cells.groupBy("doc_id", "table_ord").agg(F.max(F.col("row") + span("rowspan")).alias("n_rows"), F.max(F.col("col") + span("colspan")).alias("n_cols"), F.count("*").alias("n_cells"))


def spanned(cells: DataFrame) -> DataFrame:
    """A row per grid place that a cell covers; ``covered`` off its own place."""
    s = cells.select("*", F.explode(F.sequence("row", F.col("row") + F.col("rowspan") - 1)).alias("at_row"))
    s = s.select("*", F.explode(F.sequence("col", F.col("col") + F.col("colspan") - 1)).alias("at_col"))
    return s.withColumn("covered", (F.col("at_row") != F.col("row")) | (F.col("at_col") != F.col("col")))


def matching(cells: DataFrame, needle: str) -> DataFrame:
    """Tables one of whose cells holds a text, whatever the case."""
    return cells.where(F.contains(F.lower("text"), F.lit(needle.lower()))).select("doc_id", "table_ord").distinct()


def found(tables: DataFrame, needle: str, cells: DataFrame | None = None) -> DataFrame:
    """Tables (table_id, title, page, raw_markdown) that hold a text in any of these or in
    their cells (doc_id, table_ord, row, col, text), whatever the case; all of them for a
    blank one."""
    wanted = needle.strip().lower()
    if not wanted:
        return tables
    parts = ["table_id", F.coalesce("title", F.lit("")), F.col("page").cast("string"), F.coalesce("raw_markdown", F.lit(""))]
    if cells is not None:
        texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), " ")
        tables = tables.join(cells.groupBy("doc_id", "table_ord").agg(texts.alias("_cells")), ["doc_id", "table_ord"], "left")
        parts.append(F.coalesce("_cells", F.lit("")))
    return tables.where(F.contains(F.lower(F.concat_ws(" ", *parts)), F.lit(wanted))).drop("_cells")


def span_grid(cells: DataFrame) -> DataFrame:
    """(doc_id, table_ord, row, col, text, rowspan, colspan, covered): a row for every
    place of a table, as wide as its spans reach. Cells (cell_ord, row, col, text,
    rowspan, colspan) are laid down in order: a later one replaces what is at its own
    place and covers the rest of its span."""
    key = ["doc_id", "table_ord"]
    span = lambda c: F.greatest(F.coalesce(F.nullif(c, F.lit(0)), F.lit(1)), F.lit(1)).alias(c)
    c = cells.select(*key, "cell_ord", "row", "col", "text", span("rowspan"), span("colspan"))
    upto = lambda first, n: F.sequence(first, first + n - 1)
    laid = c.select("*", F.explode(upto(F.col("row"), F.col("rowspan"))).alias("at_row"))
    laid = laid.select("*", F.explode(upto(F.col("col"), F.col("colspan"))).alias("at_col"))
    here, own = (F.col("at_row") == F.col("row")) & (F.col("at_col") == F.col("col")), lambda x: F.when(F.col("here"), F.col(x)).alias(x)
    laid = laid.withColumn("here", here).select(*key, F.col("at_row").alias("row"), F.col("at_col").alias("col"), own("text"), own("rowspan"), own("colspan"), F.when(F.col("here"), F.col("cell_ord")).alias("ord"), F.when(~F.col("here"), F.col("cell_ord")).alias("over"))
    # What a table's cells lay is sorted once, by place; every window has this order. The first row of a place is its
    # own latest cell.
    latest = F.desc_nulls_last("ord")
    whole = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    of_table, of_place = Window.partitionBy(*key).orderBy("row", "col", latest), Window.partitionBy(*key, "row", "col").orderBy(latest)
    laid = laid.withColumns({"n_rows": F.max("row").over(whole(of_table)) + 1, "n_cols": F.max("col").over(whole(of_table)) + 1, "over": F.max("over").over(whole(of_place)), "n": F.row_number().over(of_place)})
    inside = (F.col("row") >= 0) & (F.col("col") >= 0)
    place = laid.where("n = 1").withColumn("at", F.when(inside, F.col("row").cast("long") * F.col("n_cols") + F.col("col")))
    place = place.withColumns({"before": F.coalesce(F.max("at").over(of_table.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)), "last": F.max("at").over(whole(of_table))})
    # Places that nothing lies on come with the next one that is taken, those behind the last with the last.
    no = F.array().cast("array<bigint>")
    gap = lambda first, end: F.when(end > first, F.sequence(first, end - 1)).otherwise(no)
    ahead = F.when(F.col("at").isNull(), no).otherwise(gap(F.col("before") + 1, F.col("at")))
    behind = F.when(F.col("at") == F.col("last"), gap(F.col("at") + 1, F.col("n_rows").cast("long") * F.col("n_cols"))).otherwise(no)
    place = place.withColumn("free", F.explode(F.concat(F.array(F.lit(None).cast("bigint")), ahead, behind)))
    taken, one = F.col("free").isNull(), F.lit(1)
    at = lambda x, free: F.when(taken, F.col(x)).otherwise(free.cast("int")).alias(x)
    said = lambda x, none: F.coalesce(F.when(taken, F.col(x)), none).alias(x)
    covered = taken & F.coalesce(F.col("over") > F.col("ord"), F.col("over").isNotNull())
    return place.select(*key, at("row", F.floor(F.col("free") / F.col("n_cols"))), at("col", F.col("free") % F.col("n_cols")), said("text", F.lit("")), said("rowspan", one), said("colspan", one), covered.alias("covered"))


def best_engine(tables: DataFrame) -> DataFrame:
    """Tables of each document's best engine, by number and then confidence of
    its tables, the earlier engine on ties; inaccurate candidates are dropped."""
    kept = tables.where(F.col("accuracy").isNull() | (F.col("accuracy") >= MIN_ACCURACY))
    n = kept.groupBy("doc_id", "engine", "engine_ord").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"))
    best = n.groupBy("doc_id").agg(F.max_by("engine", F.struct("n", "c", -F.col("engine_ord"))).alias("engine"))
    return kept.join(best, ["doc_id", "engine"], "left_semi")


def drop_overlaps(tables: DataFrame) -> DataFrame:
    """Tables in order, without those that have a kept one on the same page with
    a row count at most one off: a fold, since what is kept decides what is."""
    item = F.struct("table_ord", "page", "n_rows")
    zero = F.array().cast("array<struct<table_ord:int,page:int,n_rows:int>>")
    close = lambda k, x: (k["page"] == x["page"]) & (F.abs(k["n_rows"] - x["n_rows"]) <= 1)
    fold = F.aggregate("t", zero, lambda kept, x: F.when(F.exists(kept, lambda k: close(k, x)), kept).otherwise(F.concat(kept, F.array(x))))
    kept = tables.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("t")).select("doc_id", F.explode(fold).alias("k"))
    return tables.join(kept.select("doc_id", F.col("k.table_ord").alias("table_ord")), ["doc_id", "table_ord"], "left_semi")


def chains(found: Column) -> Column:
    """(table_ord, base_ord) of a document's tables, in order: the first table of the
    chain that a table continues."""
    zero = F.struct(F.lit(None).cast("int").alias("base"), F.lit(-9).alias("page"), F.lit(0).alias("n_cols"), F.array().cast("array<string>").alias("header"), F.array().cast("array<struct<table_ord:int,base_ord:int>>").alias("out"))

    def step(acc, x):
        blank = ~F.exists(x["header"], lambda c: F.coalesce(c, F.lit("")) != "")
        data = blank | ~is_header_row(x["header"]) | (x["header"] == acc["header"])
        joins = acc["base"].isNotNull() & (x["page"] == acc["page"] + 1) & (F.abs(x["n_cols"] - acc["n_cols"]) <= 1) & x["title"].isNull() & data
        return let(joins, lambda j: placed(acc, x, j))

    def placed(acc, x, joins):
        base = F.when(joins, acc["base"]).otherwise(x["table_ord"])
        return F.struct(
            base.alias("base"), x["page"].alias("page"), F.when(joins, F.greatest(acc["n_cols"], x["n_cols"])).otherwise(x["n_cols"]).alias("n_cols"),
            F.when(joins, acc["header"]).otherwise(x["header"]).alias("header"),
            F.concat(acc["out"], F.array(F.struct(x["table_ord"].alias("table_ord"), base.alias("base_ord")))).alias("out"),
        )

    return F.aggregate(F.array_sort(found), zero, step, lambda acc: acc["out"])


def islands(tables: DataFrame) -> DataFrame:
    """Tables (doc_id, table_ord, page, title, n_rows, n_cols, header) with
    ``base_ord``, the first table of the chain that they continue: the next page,
    columns at most one off, no title, and a first row that is data, empty or the
    base's header."""
    item = F.struct("table_ord", "page", "n_cols", "title", "header")
    out = tables.groupBy("doc_id").agg(F.collect_list(item).alias("t")).select("doc_id", F.explode(chains(F.col("t"))).alias("o")).select("doc_id", "o.*")
    return tables.join(out, ["doc_id", "table_ord"])


def merge_across_pages(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells of the merged tables: a continuation's header row goes, rows of the
    chain are numbered densely."""
    of_doc = tables.groupBy("doc_id").agg(F.collect_list(F.struct("table_ord", "page", "n_cols", "title", "header")).alias("t"))
    headed = F.transform(F.filter("t", lambda x: is_header_row(x["header"])), lambda x: x["table_ord"])
    # A document's chains come as one row, so that its cells are dealt by doc_id once.
    chained = of_doc.select("doc_id", chains(F.col("t")).alias("bases"), headed.alias("headed"))
    own = F.filter("bases", lambda b: b["table_ord"] == F.col("table_ord"))
    c = cells.join(chained, "doc_id").withColumn("base_ord", F.get(own, F.lit(0))["base_ord"]).where("base_ord is not null")
    c = c.where(~((F.col("table_ord") != F.col("base_ord")) & (F.col("row") == 0) & F.array_contains("headed", F.col("table_ord"))))
    dense = F.dense_rank().over(Window.partitionBy("doc_id", "base_ord").orderBy("table_ord", "row")) - 1
    return c.select("doc_id", F.col("base_ord").alias("table_ord"), dense.alias("row"), "col", "text")


def from_raw(raw: DataFrame) -> DataFrame:
    """Raw grids (doc_id, page, table_ord, grid: array<array<string>>) as tables:
    id, confidence, title, sizes, markdown, and cells as an array."""
    cells = F.flatten(F.transform("grid", lambda r, i: F.transform(r, lambda c, j: F.struct(i.alias("row"), j.alias("col"), F.trim(F.coalesce(c, F.lit(""))).alias("text")))))
    table_id = F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("_t"), F.col("table_ord").cast("string"))
    return raw.select("doc_id", "page", "table_ord", table_id.alias("table_id"), confidence(F.col("grid")).alias("confidence"), title_of(F.col("grid")[0]).alias("title"), F.size("grid").alias("n_rows"), F.array_max(F.transform("grid", F.size)).alias("n_cols"), markdown(F.col("grid")).alias("raw_markdown"), cells.alias("cells"))


def normalized_bbox(bbox: Column, width: Column, height: Column) -> Column:
    """Box by page size, six places; null if it is no box, has no area, or the page no size."""
    ok = (F.size(bbox) == 4) & (width > 0) & (height > 0) & ~F.exists(bbox, lambda x: x.isNull()) & (F.get(bbox, F.lit(2)) > F.get(bbox, F.lit(0))) & (F.get(bbox, F.lit(3)) > F.get(bbox, F.lit(1)))
    return F.when(ok, F.array(*[F.bround(bbox[i] / (width if i % 2 == 0 else height), 6) for i in range(4)]))
