"""The driver tables seen as filings: one SQL text for Spark and for the oracle.

``{name}`` stands for a table; ``{{1,700}}`` is a pattern's bound. Amounts are summed as decimals, so that the order
of summation cannot change a digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingspark import dims
from filingspark.operators import statements
from filingspark.operators.facts import REF

_AMOUNTS = """
amounts as (
  select supplier, yr, cast(price as double) as price, cast(net as double) as net, cast(qty as double) as qty from (
    select l_suppkey as supplier, cast(extract(year from l_shipdate) as int) as yr,
      sum(cast(l_extendedprice as decimal(18,4))) as price,
      sum(cast(l_extendedprice * (1 - l_discount) as decimal(18,4))) as net,
      sum(cast(l_quantity as decimal(18,4))) as qty
    from {lineitem} where l_shipdate is not null group by l_suppkey, cast(extract(year from l_shipdate) as int)) s
)"""

_CONCEPTS = [
    ("income", "Total net sales", "price"),
    ("income", "Cost of sales", "net * 6e-1"),
    ("income", "Gross margin", "price - net * 6e-1 + case when supplier % 8 = 0 then price * 2e-1 else 0e0 end"),
    ("income", "Operating income", "net * 2e-1"),
    ("income", "Net income", "net * 1e-1 - qty * 2e1"),
    ("balance", "Accounts receivable", "price * 2e-1 * (1e0 + (yr % 3) * 3e-1)"),
    ("balance", "Inventory", "qty * 1e1"),
    ("balance", "Total assets", "price * 2e0"),
    ("balance", "Total liabilities", "net * 11e-1"),
    ("balance", "Total shareholders' equity", "price * 2e0 - net * 11e-1 + case when supplier % 5 = 0 then price else 0e0 end"),
    ("cashflow", "Net cash from operating activities", "net * 1e-1 - qty * 25e0"),
    ("cashflow", "Capital expenditures", "case when supplier % 6 = 0 then qty * 3e0 else 0e0 - qty * 3e0 end"),
    ("income", "Net sales", "case when supplier % 9 = 0 then price * 9e-1 end"),
]


def _line_items_sql(spark: bool = False) -> str:
    """Line items of the amounts; Spark explodes them in one pass over the table."""
    quoted = lambda x: x.replace("'", "''")
    parts = [f"select supplier, yr, '{k}' as statement_type, {n} as item_ord, '{quoted(name)}' as name_raw, {v} as v from amounts" for n, (k, name, v) in enumerate(_CONCEPTS, 1)]
    concepts = " union all ".join(parts)
    if spark:
        rows = ", ".join(f"""struct('{k}', {n}, "{name}", cast({v} as double))""" for n, (k, name, v) in enumerate(_CONCEPTS, 1))
        concepts = f"select supplier, yr, inline(array({rows})) as (statement_type, item_ord, name_raw, v) from amounts"
    return f"""
with {_AMOUNTS}, concepts as ({concepts}), moved as (
  select *, lag(v) over (partition by supplier, name_raw order by yr) as p from concepts
)
select concat('d', cast(supplier as string), '-', cast(yr as string)) as doc_id, supplier, yr, statement_type, cast(item_ord as int) as item_ord, name_raw,
  case when (supplier + yr + item_ord) % 11 = 0 then null else v end as value_current, p as value_prior,
  case when supplier % 7 = 0 and item_ord % 4 = 2 then 'USD thousand' else 'USD millions' end as unit,
  case when supplier % 13 = 0 and item_ord = 3 then 'EUR' else 'USD' end as currency,
  case when (supplier + item_ord) % 5 = 0 then null else cast(item_ord % 3 + 1 as int) end as page,
  cast(50 + (supplier + item_ord) % 50 as double) / 1e2 as ref_confidence,
  case when item_ord % 2 = 0 then 'grid' end as engine
from moved where not (name_raw = 'Net sales' and v is null)"""


def _filing_pages_sql(lines: str, spark: bool = False) -> str:
    """Line items printed on three pages of a filing, some with an auditor's remark."""
    return f"""
select doc_id, page_number, concat(case when page_number = 1 and supplier % 10 = 4 then concat('There is substantial doubt: going concern.', chr(10)) else concat('Filing of supplier', chr(10)) end, {lines}) as text
from (select doc_id, supplier, item_ord, case statement_type when 'income' then 1 when 'balance' then 2 else 3 end as page_number,
  concat(name_raw, ': ', cast(cast(floor(abs(value_current)) as bigint) as string)) as line from ({_line_items_sql(spark)}) v where value_current is not null) i
group by doc_id, supplier, page_number"""


VIEWS = {
    "v_line_items": _line_items_sql(),
    "v_statements": f"""
with {_AMOUNTS} select concat('d', cast(supplier as string), '-', cast(yr as string)) as doc_id, k.statement_type,
  make_date(yr, 1, 1) as period_start, make_date(yr, case when supplier % 4 = 1 then 9 else 12 end, 30) as period_end, 65e-2 as confidence
from amounts cross join (select 'income' as statement_type union all select 'balance' union all select 'cashflow') k""",
    "v_prices": """
select o_orderpriority as ticker, cast(o_orderdate as date) as trade_date,
  cast(avg(cast(o_totalprice as decimal(18,2))) as decimal(18,4)) as close, count(*) as volume
from {orders} group by o_orderpriority, cast(o_orderdate as date)""",
    "v_bench": """
select cast(o_orderdate as date) as trade_date, cast(avg(cast(o_totalprice as decimal(18,2))) as decimal(18,4)) as close
from {orders} group by cast(o_orderdate as date)""",
    "v_events": """
select t.ticker, d.event_date from (select distinct o_orderpriority as ticker from {orders}) t
cross join (select date '1997-03-02' as event_date union all select date '1999-06-15' union all select date '2030-01-01') d""",
    "v_pages": """
select doc_id, cast(unnest(range(1, len(p) + 1)) as int) as page_number, unnest(p) as text
from (select doc_id, regexp_extract_all(text, '(?s).{{1,700}}') as p from {documents} where text is not null) d""",
    "v_filing_pages": _filing_pages_sql("string_agg(line, chr(10) order by item_ord)"),
    "v_cells": """
select cast(l_orderkey as string) as doc_id, 0 as table_ord, cast(n - 1 as int) as row, c.col,
  case c.col when 0 then case n when 1 then 'Revenue' when 2 then 'Cost of sales' when 3 then '净利润' else l_returnflag end
    when 1 then case n % 4 when 0 then concat('(', cast(cast(l_quantity as int) as string), ',000)') when 1 then concat('$', cast(cast(l_quantity as int) as string), '万')
      when 2 then concat(cast(cast(l_quantity as int) as string), '.5%') else concat('△', cast(cast(l_quantity as int) as string)) end
    else l_linestatus end as text
from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_returnflag, l_linestatus) as n from {lineitem}) l
cross join (select 0 as col union all select 1 union all select 2) c""",
    "v_corrections": """
select event_id as corr_ord, user_id, case event_type when 'click' then 'value' when 'view' then 'label' when 'purchase' then 'evidence' else 'colour' end as field_name,
  event_type, value, ts from {events}""",
}
_ROWS = """
select doc_id, 0 as table_ord, cast(n - 1 as int) as row, array(
  coalesce(case n when 1 then 'Revenue' when 2 then 'Cost of sales' when 3 then '净利润' else l_returnflag end, ''),
  coalesce(case n % 4 when 0 then concat('(', cast(cast(l_quantity as int) as string), ',000)') when 1 then concat('$', cast(cast(l_quantity as int) as string), '万')
    when 2 then concat(cast(cast(l_quantity as int) as string), '.5%') else concat('△', cast(cast(l_quantity as int) as string)) end, ''),
  coalesce(l_linestatus, '')) as texts
from (select *, row_number() over (partition by doc_id order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_returnflag, l_linestatus) as n
  from (select cast(l_orderkey as string) as doc_id, * from {lineitem}) i) l"""
# Pages are whole texts in slices of 700 characters. Lists are exploded here, which has no common syntax. Cells are
# dealt by doc_id once, as line items; what groups them by document and table needs no other shuffle.
# ``v_rows`` are the same tables by row, for what needs whole grids.
_SPARK_VIEWS = VIEWS | {
    "v_line_items": _line_items_sql(spark=True),
    "v_filing_pages": _filing_pages_sql("array_join(transform(array_sort(collect_list(struct(item_ord, line))), x -> x.line), chr(10))", spark=True),
    "v_cells": """
select doc_id, 0 as table_ord, cast(n - 1 as int) as row, inline(array(
  struct(0, case n when 1 then 'Revenue' when 2 then 'Cost of sales' when 3 then '净利润' else l_returnflag end),
  struct(1, case n % 4 when 0 then concat('(', cast(cast(l_quantity as int) as string), ',000)') when 1 then concat('$', cast(cast(l_quantity as int) as string), '万')
    when 2 then concat(cast(cast(l_quantity as int) as string), '.5%') else concat('△', cast(cast(l_quantity as int) as string)) end),
  named_struct("col1", 2, "col2", l_linestatus))) as (col, text)
from (select *, row_number() over (partition by doc_id order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_returnflag, l_linestatus) as n
  from (select cast(l_orderkey as string) as doc_id, * from {lineitem}) i) l""",
    "v_rows": _ROWS,
    "v_pages": """
select doc_id, cast(n + 1 as int) as page_number, text
from (select doc_id, posexplode(regexp_extract_all(text, '(?s).{{1,700}}', 0)) as (n, text) from {documents}) d""",
}
_TABLES = ("lineitem", "orders", "documents", "events")


def view(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A view over the tables of ``sf_dir``, or over those ``given`` in their place; only the tables it names are read."""
    sql = _SPARK_VIEWS[name]
    used = {t: given[t] if t in given else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


def oracle(body: str, *names: str) -> str:
    """Oracle SQL: ``body`` over the named views as common table expressions."""
    parts = [f"{n} as ({VIEWS[n].format(**{t: t for t in _TABLES})})" for n in names]
    return f"with {', '.join(parts)} {body}" if not body.lstrip().lower().startswith("with ") else f"with {', '.join(parts)}, {body.lstrip()[5:]}"


def refs() -> Column:
    """Evidence of a derived line item; none where it has no page."""
    ref = F.struct(
        F.lit("table").alias("ref_type"), F.col("page"), F.lit("t1").alias("table_id"), F.col("item_ord").alias("row"), F.lit(1).alias("col"),
        F.lit(None).cast("array<double>").alias("bbox"), F.col("name_raw").alias("quote"), F.col("ref_confidence").alias("confidence"), F.col("engine"), F.lit(None).cast("string").alias("artifact_path"),
    )
    return F.when(F.col("page").isNotNull(), F.array(ref.cast(REF))).otherwise(F.array().cast(f"array<{REF}>"))


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = view(spark, sf_dir, "v_line_items").withColumn("source_refs", refs()).withColumn("confidence", F.lit(0.65)).withColumn("notes", F.lit(None).cast("string"))
    return statements.normalize_accounts(items)


def accounts_sql() -> str:
    """The account dictionary for the oracle."""
    rows = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in kv)) for kv in dims.ACCOUNTS.items())
    return f"accounts as (select * from (values {rows}) t(account, concept)), items as (select i.*, coalesce(l.concept, e.concept, trim(name_raw)) as name_norm from v_line_items i left join accounts l on lower(trim(i.name_raw)) = l.account left join accounts e on trim(i.name_raw) = e.account)"


def totals_sql() -> str:
    known = ", ".join(f"'{c}'" for c in dims.TOTAL_CONCEPTS)
    return f"totals as (select doc_id, statement_type, name_norm as concept, arg_max(value_current, item_ord) as value from items where name_norm in ({known}) and value_current is not null group by all)"
