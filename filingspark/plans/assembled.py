"""Queries over what is put together of several parts: routed tables, whole reports, statements by their path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingspark.operators import listing, routing, statements, tables, validate
from filingspark.plans import filings
from filingspark.plans.views import line_items, oracle, view

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Orders as what two engines found in filings of sixteen, two tables to a page: the
    first engine knows boxes, the second accuracies and a second way."""
    order = F.col("doc_id").cast("long")
    rows = view(spark, d, "v_rows").withColumn("texts", F.slice("texts", 1, F.when(order % 4 == 3, 3).otherwise(2)))
    grid = tables.row_grids(rows).select(order.alias("key"), F.col("grid").alias("g"))
    key = F.col("key")
    titled = F.when(key % 7 == 0, F.concat(F.array(F.array(F.lit("Balance sheet"))), F.col("g"))).otherwise(F.col("g"))
    base = grid.select("key", F.floor(key / 16).alias("doc_id"), (key % 16).cast("int").alias("table_ord"), titled.alias("grid")).withColumn("page", F.floor(F.col("table_ord") / 2).cast("int") + 1)
    box = F.array(50 + key % 7, 40 + key % 11, 500 + key % 13, F.lit(650)).cast("array<double>")
    none = F.lit(None).cast("array<double>")
    names = ("engine", "engine_ord", "fallback", "bbox", "page_width", "page_height", "accuracy")
    of = lambda *values: F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(n) for n, x in zip(names, values, strict=True)])
    first = F.when(key % 5 != 0, of("pdfplumber", 0, False, box, 600.0, 900.0, F.lit(None).cast("double")))
    second = F.when(key % 3 != 0, of("camelot", 1, key % 4 == 1, none, 0.0, 0.0, (key * 37 % 101).cast("double")))
    # An order is read once and seen by both.
    return base.withColumn("seen", F.explode(F.array_compact(F.array(first, second)))).select("doc_id", "table_ord", "grid", "page", "seen.*")


ROUTES = """r_ as (select cast(doc_id as bigint) as key, row, list(text order by col) as r from v_cells where col < case when cast(doc_id as bigint) % 4 = 3 then 3 else 2 end group by all),
g_ as (select key, list(r order by row) as g from r_ group by key),
b_ as (select key, key // 16 as doc_id, cast(key % 16 as int) as table_ord, cast(key % 16 // 2 + 1 as int) as page, case when key % 7 = 0 then list_prepend(['Balance sheet'], g) else g end as grid, case when key % 4 = 3 then 3 else 2 end as n_cols, key % 7 = 0 as titled, len(g) as m from g_),
c_ as (select *, 'pdfplumber' as engine, 0 as engine_ord, false as fallback, cast(round_even(least(55e-2 + m / (m * n_cols + case when titled then 1 else 0 end) * 4e-1, 95e-2) * 100, 0) as int) as h from b_ where key % 5 <> 0
  union all select *, 'camelot', 1, key % 4 = 1, cast(key * 37 % 101 as int) from b_ where key % 3 <> 0 and key * 37 % 101 >= 10),
o_ as (select *, fallback and coalesce(abs(len(grid) - lag(len(grid)) over (partition by doc_id, engine_ord, page order by table_ord)) <= 1, false) as over_ from c_),
n_ as (select doc_id, engine_ord, row_number() over (partition by doc_id order by count(*) desc, sum(h) desc, engine_ord) as place from o_ where not over_ group by doc_id, engine_ord),
k_ as (select o_.*, grid[1] as header, titled or o_.n_cols = 3 as hdr, row_number() over (partition by doc_id order by table_ord) as rn from o_ join n_ using (doc_id, engine_ord) where not over_ and place = 1),
chain as (select doc_id, rn, table_ord, table_ord as base_ord, page, header from k_ where rn = 1
  union all select doc_id, rn, table_ord, case when j then was else table_ord end, page, case when j then said else header end from (
    select k.doc_id, k.rn, k.table_ord, k.page, k.header, c.base_ord as was, c.header as said, k.page = c.page + 1 and not k.titled and (not k.hdr or k.header = c.header) as j from chain c join k_ k on k.doc_id = c.doc_id and k.rn = c.rn + 1) x),
p_ as (select k_.*, base_ord, table_ord <> base_ord and hdr as cut, concat('p', page, '_t', table_ord) as tid from k_ join (select doc_id, table_ord, base_ord from chain) c using (doc_id, table_ord)),
t_ as (select doc_id, base_ord, any_value(engine) as engine, count(*) as n_parts, concat(arg_min(tid, table_ord), case when count(*) > 1 then '_merged' else '' end) as table_id, arg_min(page, table_ord) as page, bool_or(titled and table_ord = base_ord) as titled, max(n_cols) as n_cols,
  flatten(list(case when cut then grid[2:] else grid end order by table_ord)) as g, string_agg(h, ',' order by table_ord) as hundredths from p_ group by doc_id, base_ord)"""
_recursive = lambda sql: sql.replace("with ", "with recursive ", 1)
_LINE = "'| ' || array_to_string(list_concat(r, list_resize([]::varchar[], n_cols - len(r), '')), ' | ') || ' |'"


@query("routed_tables", _recursive(oracle(f"""with {ROUTES}, l_ as (select *, list_transform(g, lambda r: {_LINE}) as l from t_)
select doc_id, engine, table_id, page, case when titled then 'Balance sheet' end as title, n_parts, len(g) as n_rows, n_cols, hundredths, concat_ws(chr(10), l[1], '| ' || array_to_string(list_resize([]::varchar[], n_cols, '---'), ' | ') || ' |', case when len(l) > 1 then array_to_string(l[2:], chr(10)) end) as raw_markdown from l_""", "v_cells")))
def routed_tables(spark: SparkSession, d: str) -> DataFrame:
    hundredths = F.transform("source_refs", lambda r: F.round(r["confidence"] * 100).cast("int").cast("string"))
    return routing.routed(_candidates(spark, d)).select("doc_id", "engine", "table_id", "page", "title", F.size("source_refs").alias("n_parts"), "n_rows", "n_cols", F.array_join(hundredths, ",").alias("hundredths"), "raw_markdown")


@query("routed_cells", _recursive(oracle(f"""with {ROUTES}, i_ as (select *, unnest(range(len(grid))) as i from p_), w_ as (select *, row_number() over (partition by doc_id, base_ord order by table_ord, i) - 1 as row, unnest(range(len(grid[i + 1]))) as j from i_ where not cut or i > 0),
x_ as (select *, case when engine_ord = 0 then 50e0 + key % 7 end as x0, 40e0 + key % 11 as y0, 500e0 + key % 13 as x1, 650e0 as y1, len(grid)::double as n from w_)
select x_.doc_id, t_.table_id, cast(row as int) as row, cast(j as int) as col, grid[i + 1][j + 1] as text, round_even((x0 + (x1 - x0) * j / x_.n_cols) / 600, 6) as x0, case when x0 is not null then round_even((y0 + (y1 - y0) * i / n) / 900, 6) end as y0, round_even((x0 + (x1 - x0) * (j + 1) / x_.n_cols) / 600, 6) as x1, case when x0 is not null then round_even((y0 + (y1 - y0) * (i + 1) / n) / 900, 6) end as y1
from x_ join t_ using (doc_id, base_ord)""", "v_cells")))
def routed_cells(spark: SparkSession, d: str) -> DataFrame:
    c = routing.cells(routing.routed(_candidates(spark, d)))
    return c.select("doc_id", "table_id", "row", "col", "text", *[F.get("bbox", F.lit(k)).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))])


def _even(spark: SparkSession, d: str) -> DataFrame:
    """Documents of even suppliers, with the supplier."""
    docs = filings._docs(spark, d).withColumn("supplier", F.regexp_extract("doc_id", r"^d(\d+)-", 1).cast("long"))
    return docs.where("supplier % 2 = 0")


_REFLESS = "struct<page:int,ref_type:string,quote:string>"
_EVEN = "cast(regexp_extract(doc_id, '^d(\\d+)-', 1) as bigint)"


@query("full_reports", oracle(f"""{filings.SIGNAL_ROWS}, snap as (select doc_id, string_agg(concat('- ', concept, ': ', printf('%.2f', value)), chr(10) order by concept) as t from (select doc_id, concept, arg_max(value, case statement_type when 'income' then 1 when 'balance' then 2 else 3 end) as value from totals group by all) x group by doc_id),
sg as (select doc_id, string_agg(concat('- ', title, ' (', severity, '): ', description, chr(10), '  - Evidence: page ', coalesce(cast(page as varchar), 'None'), ' (', ref_type, ') ', evidence), chr(10) order by category) as t from (
  select r.*, case when evidence = 'Evidence unavailable' then 1 else c.page end as page, case when evidence = 'Evidence unavailable' then 'page_text' else 'table' end as ref_type from rows_ r left join (select doc_id, statement_type, arg_min(page, item_ord) as page from items where page is not null group by all) c on c.doc_id = r.doc_id and c.statement_type = case r.category when 'cash_vs_profit' then 'cashflow' else 'balance' end) y group by doc_id),
d as (select distinct doc_id, {_EVEN} as supplier from v_statements)
select d.doc_id, concat_ws(chr(10), concat('# Trader Report for ', d.doc_id, '.pdf'), '', '## Executive Summary', case when supplier % 4 = 0 then 'A written summary.' else concat('Parsed 3 pages for ', d.doc_id, '.pdf.') end, '', '## Key Drivers',
  case when supplier % 4 = 0 then concat('- Prices', chr(10), '- Volumes') else '- See extracted statements and notes.' end, '', '## Numbers Snapshot', snap.t, '', '## Risk Signals', sg.t,
  case when supplier % 8 = 0 then concat(chr(10), '## Deep Analysis', chr(10), 'Margins fell.', chr(10), '- Margin (low): Below last year.', chr(10), '  - Evidence: page 1 (page_text) ') end,
  '', '## Notes', case when supplier % 2 = 0 then concat('- impairment: Goodwill tested.', chr(10), '  - Evidence: page 2 (page_text) Goodwill', chr(10), '- guidance: Flat.') end, '', '## Limitations',
  case when supplier % 4 = 0 then concat('- Audit pending.', chr(10)) else '' end || case when supplier % 8 = 0 then concat('- No peers.', chr(10)) else '' end || concat('- Not financial advice.', chr(10), '- Outputs depend on PDF extraction quality.'), concat(chr(10), 'Generated at 2024-01-01.')) as report
from d left join snap using (doc_id) left join sg using (doc_id)""", "v_line_items", "v_statements"))
def full_reports(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    docs, even = filings._docs(spark, d), _even(spark, d)
    meta = docs.select("doc_id", F.concat("doc_id", F.lit(".pdf")).alias("filename"), F.lit(3).alias("n_pages"), F.lit("2024-01-01").alias("created_at"))
    signals = filings._signals(spark, d).withColumn("sig_ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("category")))
    ref = lambda page, quote: F.array(F.struct(F.lit(page).alias("page"), F.lit("page_text").alias("ref_type"), F.lit(quote).cast("string").alias("quote")).cast(_REFLESS))
    note = lambda n, kind, summary, refs: F.struct(F.lit(n).alias("note_ord"), F.lit(kind).alias("note_type"), F.lit(summary).alias("summary"), refs.alias("source_refs"))
    notes = even.select("doc_id", F.explode(F.array(note(1, "impairment", "Goodwill tested.", ref(2, "Goodwill")), note(2, "guidance", "Flat.", F.array().cast(f"array<{_REFLESS}>")))).alias("x")).select("doc_id", "x.*")
    deep = F.col("supplier") % 8 == 0
    drafts = even.where("supplier % 4 = 0").select(
        "doc_id", F.lit("A written summary.").alias("executive_summary"), F.array(F.lit("Prices"), F.lit("Volumes")).alias("key_drivers"), F.array(F.lit("Audit pending."), F.lit("Not financial advice.")).alias("limitations"),
        F.when(deep, "Margins fell.").alias("deep_summary"), F.when(deep, F.array(F.lit("No peers."))).alias("deep_limitations"),
    )
    findings = even.where("supplier % 8 = 0").select("doc_id", F.lit(1).alias("sig_ord"), F.lit("Margin").alias("title"), F.lit("low").alias("severity"), F.lit("Below last year.").alias("description"), ref(1, None).alias("evidence"))
    return listing.full_report(meta, listing.numbers_snapshot(statements.statement_totals(line_items(spark, d))), signals, notes, drafts, findings)


@query("statement_paths", oracle("""with k as (select distinct doc_id, cast(regexp_extract(doc_id, '^d(\\d+)-', 1) as bigint) as supplier from v_statements),
n as (select doc_id, count(*) filter (statement_type = 'income') as income, count(*) filter (item_ord in (8, 9, 10) and value_current is not null) as balance, count(*) filter (item_ord = 12 and value_current is not null) as cashflow from v_line_items group by doc_id),
p as (select k.doc_id, t.statement_type, case t.statement_type when 'income' then case when supplier % 3 = 0 then 'tables' else 'text' end when 'balance' then case when supplier % 3 = 2 or n.balance = 0 then 'none' else 'text' end else case when n.cashflow = 0 then 'none' else 'text' end end as path, n.income
  from k join n using (doc_id) cross join (values ('income'), ('balance'), ('cashflow')) t(statement_type))
select doc_id, statement_type, path, case path when 'tables' then income when 'none' then 0 end as n_items, case path when 'tables' then 65e-2 when 'text' then 7e-1 else 2e-1 end as extraction_confidence, case when path = 'none' then 'llm_parse_failed,no_line_items' else '' end as issues from p""", "v_line_items", "v_statements"))
def statement_paths(spark: SparkSession, d: str) -> DataFrame:
    """Tables hold the income of every third supplier; another third prints no balance."""
    supplier = F.regexp_extract("doc_id", r"^d(\d+)-", 1).cast("long")
    i = view(spark, d, "v_line_items").where("supplier % 3 = 0 and statement_type = 'income'")
    cell = F.explode(F.array(F.struct(F.lit(0).alias("col"), F.col("name_raw").alias("text")), F.struct(F.lit(1).alias("col"), F.format_string("%.2f", "value_current").alias("text"))))
    grids = i.select("doc_id", F.lit(0).alias("table_ord"), F.col("item_ord").alias("row"), F.lit("Income statement").alias("title"), cell.alias("c")).select("doc_id", "table_ord", "row", "title", "c.*")
    pages = view(spark, d, "v_filing_pages").where(~((supplier % 3 == 2) & (F.col("page_number") == 2)))
    s = statements.by_path(filings._docs(spark, d), statements.from_grids(grids), statements.from_pages(pages))
    # How many labels a text holds is left to the tests.
    return s.select("doc_id", "statement_type", "path", F.when(F.col("path") != "text", F.col("n_items")).alias("n_items"), "extraction_confidence", F.array_join("issues", ",").alias("issues"))


@query("validation_results", oracle(f"""{filings.CHECKED} select d.doc_id, coalesce((select string_agg(issue, '|' order by issue) from issues i where i.doc_id = d.doc_id), '') as issues,
  round(abs(assets - (liabilities + equity)) / greatest(assets, 1.0), 6) as balance_equation, case when net_income is not null then round(operating_cf / greatest(abs(net_income), 1e-6), 6) end as profit_to_cfo_ratio, case when not isnan(ar) and not isnan(rev) then round(ar - rev, 6) end as ar_growth_vs_rev_growth
from (select distinct doc_id from items) d left join find_ using (doc_id) left join g using (doc_id)""", "v_line_items"))
def validation_results(spark: SparkSession, d: str) -> DataFrame:
    r = validate.validation_results(validate.profile(line_items(spark, d)))
    of = lambda m, k: F.round(F.element_at(m, k), 6).alias(k)
    return r.select("doc_id", F.array_join(F.array_sort("issues"), "|").alias("issues"), of("checks", "balance_equation"), of("metrics", "profit_to_cfo_ratio"), of("metrics", "ar_growth_vs_rev_growth"))
