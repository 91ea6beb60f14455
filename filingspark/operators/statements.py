"""Statements: account names, totals and lookups over line items.

Line items are rows (doc_id, statement_type, item_ord, name_raw, name_norm,
value_current, value_prior, unit, currency, notes, source_refs); ``item_ord``
makes first and last explicit, so no result depends on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingspark import dims
from filingspark.functions import numbers, text

KEYS = ("doc_id", "statement_type")


def normalize_accounts(df: DataFrame, raw: str = "name_raw", out: str = "name_norm") -> DataFrame:
    """Adds the concept of an account name: lower-cased, else as it is, else
    the trimmed name itself."""
    dim = F.broadcast(dims.accounts(df))  # a fixed dictionary of some forty rows
    lower = dim.select(F.col("account").alias("_l"), F.col("concept").alias("_lc"))
    exact = dim.select(F.col("account").alias("_e"), F.col("concept").alias("_ec"))
    name = F.trim(F.col(raw))
    joined = df.join(lower, F.lower(name) == F.col("_l"), "left").join(F.broadcast(exact), name == F.col("_e"), "left")
    return joined.withColumn(out, F.coalesce("_lc", "_ec", name)).drop("_l", "_lc", "_e", "_ec")


def statement_totals(items: DataFrame) -> DataFrame:
    """(doc_id, statement_type, concept, value): the last value of each total."""
    known = items.where(F.col("name_norm").isin(*dims.TOTAL_CONCEPTS) & F.col("value_current").isNotNull())
    return known.groupBy(*KEYS, F.col("name_norm").alias("concept")).agg(F.max_by("value_current", "item_ord").alias("value"))


def find_totals(items: DataFrame, totals: DataFrame, concepts: dict[str, tuple[str, str]]) -> DataFrame:
    """A row per document with a column per entry (statement type, concept): the
    total, else the first line item with a value. One shuffle on doc_id."""
    t = totals.select("doc_id", "statement_type", "concept", "value", F.lit(-1).alias("ord"))
    i = items.where("value_current is not null").select("doc_id", "statement_type", F.col("name_norm").alias("concept"), F.col("value_current").alias("value"), F.col("item_ord").cast("int").alias("ord"))
    wanted = lambda k, c: (F.col("statement_type") == k) & (F.col("concept") == c)
    return t.unionByName(i).groupBy("doc_id").agg(*[F.min_by(F.when(wanted(k, c), F.col("value")), F.when(wanted(k, c), F.col("ord"))).alias(name) for name, (k, c) in concepts.items()])


def found_total(statement_type: str, concept: str, derived: bool = True) -> Column:
    """Aggregate over line items: the last value of a total concept where totals
    are ``derived`` from the items, else the first line item with a value."""
    hit = (F.col("statement_type") == statement_type) & (F.col("name_norm") == concept) & F.col("value_current").isNotNull()
    of = F.max_by if derived and concept in dims.TOTAL_CONCEPTS else F.min_by
    return of(F.when(hit, F.col("value_current")), F.when(hit, F.col("item_ord")))


def named(statement_type: str, *keywords: str) -> Column:
    """Line items of a statement whose names hold a keyword, whatever the case."""
    name = F.lower(F.concat_ws(" ", "name_raw", "name_norm"))
    return (F.col("statement_type") == statement_type) & text.contains_any(name, [k.lower() for k in keywords])


def from_grids(cells: DataFrame) -> DataFrame:
    """Line items of table grids: (doc_id, table_ord, row, col, text) with the
    account in column 0, the current value in 1 and the prior one in 2. Grids
    without a kind of statement are left out; confidence .65."""
    head = F.when(F.col("row") < 3, F.struct("row", "col", "text"))
    kinds = cells.groupBy("doc_id", "table_ord").agg(F.array_sort(F.collect_list(head)).alias("head"), F.max(F.col("title") if "title" in cells.columns else F.lit(None).cast("string")).alias("title"))
    kinds = kinds.withColumn("statement_type", text.statement_type(F.col("title"), F.array_join(F.transform("head", lambda h: h["text"]), " "))).where("statement_type is not null")
    at = lambda c: F.max(F.when(F.col("col") == c, F.col("text")))
    rows = cells.groupBy("doc_id", "table_ord", "row").agg(F.coalesce(at(0), F.lit("")).alias("name_raw"), at(1).alias("c"), at(2).alias("p"))
    order = Window.partitionBy("doc_id", "statement_type").orderBy("table_ord", "row")
    items = rows.join(kinds.select("doc_id", "table_ord", "statement_type"), ["doc_id", "table_ord"])
    items = items.select("doc_id", "statement_type", F.row_number().over(order).alias("item_ord"), "table_ord", "name_raw", numbers.parse_number(F.col("c")).alias("value_current"), numbers.parse_number(F.col("p")).alias("value_prior"))
    # A line item cites its table.
    ref = F.struct(
        F.lit("table").alias("ref_type"), F.lit(None).cast("int").alias("page"), F.concat(F.lit("t"), F.col("table_ord").cast("string")).alias("table_id"), *[F.lit(None).cast("int").alias(c) for c in ("row", "col")],
        F.lit(None).cast("array<double>").alias("bbox"), F.left("name_raw", F.lit(200)).alias("quote"), F.lit(0.65).alias("confidence"), *[F.lit(None).cast("string").alias(c) for c in ("engine", "artifact_path")],
    )
    none = F.lit(None).cast("string")
    items = normalize_accounts(items).withColumns({"confidence": F.lit(0.65), "unit": none, "currency": none, "notes": none, "source_refs": F.array(ref)})
    return items.drop("table_ord")


# Labels of metrics in page text, by statement, in the order in
# which they are tried, with the place of the preferred number after the label.
LABELS = {
    "income": (
        ("Revenue", "revenue", 2), ("Total net sales", "revenue", 2), ("Net sales", "revenue", 2), ("营业收入", "revenue", 2),
        ("Total cost of sales", "cost_of_goods_sold", 2), ("Cost of goods sold", "cost_of_goods_sold", 2), ("营业成本", "cost_of_goods_sold", 2),
        ("Gross margin", "gross_profit", 2), ("Gross Profit", "gross_profit", 2), ("毛利润", "gross_profit", 2),
        ("Operating profit", "operating_income", 2), ("Operating income", "operating_income", 2), ("营业利润", "operating_income", 2),
        ("Net income", "net_income", 2), ("净利润", "net_income", 2),
    ),
    "balance": (
        ("Cash and equivalents", "cash_and_equivalents", 0), ("Cash and cash equivalents", "cash_and_equivalents", 0), ("货币资金", "cash_and_equivalents", 0),
        ("Total Assets", "total_assets", 0), ("Total assets", "total_assets", 0), ("资产总计", "total_assets", 0),
        ("Total Liabilities", "total_liabilities", 0), ("Total liabilities", "total_liabilities", 0), ("负债合计", "total_liabilities", 0),
        ("Total Equity", "total_equity", 0), ("Total shareholders’ equity", "total_equity", 0), ("Total shareholders' equity", "total_equity", 0), ("所有者权益合计", "total_equity", 0),
        ("Total liabilities and shareholders’ equity", "total_liabilities_and_equity", 0), ("Total liabilities and shareholders' equity", "total_liabilities_and_equity", 0),
    ),
    "cashflow": (
        ("Cash flow from operations", "operating_cf", 0), ("Cash generated by operating activities", "operating_cf", 0), ("Net cash provided by operating activities", "operating_cf", 0),
        ("经营活动产生的现金流量净额", "operating_cf", 0), ("Capital expenditures", "capex", 0), ("购建固定资产、无形资产和其他长期资产支付的现金", "capex", 0),
        ("Cash generated by investing activities", "investing_cf", 0), ("Cash used in financing activities", "financing_cf", 0),
    ),
}
INCOME_BOUNDS = ("Operating expenses", "营业费用")
SNIPPET = 260


def from_pages(pages: DataFrame) -> DataFrame:
    """Line items of page text (doc_id, page_number, text): for every concept the
    first label with a number behind it, on the first such page; confidence .7."""
    bounds = {k: [label for label, _, _ in v] + (list(INCOME_BOUNDS) if k == "income" else []) for k, v in LABELS.items()}
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    low = pages.select("doc_id", "page_number", flat.alias("flat")).withColumn("low", F.lower("flat"))
    # Labels that a page holds, of the fixed list. They are no join: a filter behind one becomes its condition, and
    # what it looks at is then made several times a label.
    known = F.array(*[
        F.struct(
            F.lit(kind).alias("statement_type"), F.lit(n).alias("label_ord"), F.lit(label).alias("label"), F.lit(label.lower()).alias("needle"), F.lit(concept).alias("concept"), F.lit(place).alias("place"),
            F.array(*[F.lit(x.lower()) for x in bounds[kind] if x.lower() != label.lower()]).alias("bounds"),
        ) for kind, found in LABELS.items() for n, (label, concept, place) in enumerate(found)
    ])
    met = low.select("doc_id", "page_number", "flat", "low", F.explode(F.filter(known, lambda x: F.contains(F.col("low"), x["needle"]))).alias("k")).select("doc_id", "page_number", "flat", "low", "k.*")
    met = met.withColumn("snippet", F.expr(f"substring(flat, locate(needle, low), {SNIPPET})"))
    ends = text.let(F.lower("snippet"), lambda s: F.transform("bounds", lambda b: F.call_function("locate", b, s, F.length("label") + 1)))
    met = met.withColumn("cut", F.array_min(F.filter(ends, lambda p: p > 0)))
    segment = F.when(F.col("cut").isNull(), F.col("snippet")).otherwise(F.rtrim(F.expr("left(snippet, cut - 1)")))
    met = met.withColumn("segment", segment).withColumn("values", numbers.parse_numbers(F.col("segment")))
    chosen = F.when((F.col("place") <= 0) | (F.size("values") <= 2), F.get("values", F.lit(0))).otherwise(F.get("values", F.least(F.col("place"), F.size("values") - 1)))
    # Labels without a number are passed over by the aggregate, which no filter is pushed through.
    told = lambda x: F.when(F.size("values") > 0, x)
    first = met.groupBy("doc_id", "statement_type", "concept").agg(F.min_by(told(F.struct("label_ord", "label", chosen.alias("value"), "page_number", "segment")), told(F.struct("label_ord", "page_number"))).alias("m")).where("m is not null")
    said = first.select("doc_id", "statement_type", F.col("m.label_ord").alias("item_ord"), F.col("m.label").alias("name_raw"), F.col("concept").alias("name_norm"), F.col("m.value").alias("value_current"), F.col("m.page_number").alias("page"), text.quote(F.col("m.segment")).alias("quote"), F.lit(0.7).alias("confidence"))
    return said.withColumn("notes", F.lit("text_extracted"))


# What amounts are in where a text doesn't say, by its language.
CURRENCY_BY_LANGUAGE = {"zh": "CNY", "cn": "CNY", "en": "USD", "default": "CNY"}
UNIT_BY_LANGUAGE = {"zh": "万元", "cn": "万元", "en": "USD millions", "default": "万元"}


def with_language_defaults(items: DataFrame, languages: DataFrame) -> DataFrame:
    """Items with unit and currency by their document's language (doc_id, lang)."""
    entries = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    by = lambda table: F.coalesce(F.element_at(entries(table), F.coalesce("_lang", F.lit("default"))), F.lit(table["default"]))
    j = items.join(languages.select("doc_id", F.col("lang").alias("_lang")), "doc_id", "left")
    return j.withColumns({"unit": by(UNIT_BY_LANGUAGE), "currency": by(CURRENCY_BY_LANGUAGE)}).drop("_lang")


def prefer_tables(from_tables: DataFrame, from_text: DataFrame) -> DataFrame:
    """Table items of a statement where there are any, else those of the text."""
    held = from_tables.select(*KEYS).distinct()
    return from_tables.unionByName(from_text.join(held, list(KEYS), "left_anti"), allowMissingColumns=True)


# How much the items of each path are trusted, and what a statement without any says.
PATHS = {"tables": 0.65, "text": 0.7, "none": 0.2}
KINDS = ("income", "balance", "cashflow")
NO_ITEMS = ("llm_parse_failed", "no_line_items")


def by_path(docs: DataFrame, from_tables: DataFrame, from_text: DataFrame) -> DataFrame:
    """(doc_id, statement_type, path, n_items, extraction_confidence, issues): a row for each of the three statements of
    every document, made of table items where there are any, else of those of the text, else empty, with its issues.
    Items of documents that are not in ``docs`` are left out; the items themselves are those of ``prefer_tables``."""
    of = lambda df, path: df.select(*KEYS, F.lit(path).alias("p"))
    n = of(from_tables, "tables").unionByName(of(from_text, "text")).groupBy(*KEYS).agg(*[F.count_if(F.col("p") == p).alias(p) for p in ("tables", "text")])
    every = docs.select("doc_id").distinct().select("doc_id", F.explode(F.array(*map(F.lit, KINDS))).alias("statement_type"))
    j = every.join(n, list(KEYS), "left")
    j = j.withColumn("path", F.when(F.col("tables") > 0, "tables").when(F.col("text") > 0, "text").otherwise("none"))
    held = F.when(F.col("path") == "tables", F.col("tables")).when(F.col("path") == "text", F.col("text")).otherwise(F.lit(0))
    trust = F.when(F.col("path") == "tables", PATHS["tables"]).when(F.col("path") == "text", PATHS["text"]).otherwise(PATHS["none"])
    issues = F.when(F.col("path") == "none", F.array(*map(F.lit, NO_ITEMS))).otherwise(F.array().cast("array<string>"))
    return j.select(*KEYS, "path", held.alias("n_items"), trust.alias("extraction_confidence"), issues.alias("issues"))
