"""Queries over derived statements: totals, facts, validation, signals, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingspark import dims
from filingspark.functions import dates, numbers, text
from filingspark.operators import event_study as es
from filingspark.operators import export, facts, signals, statements, validate
from filingspark.plans.views import VIEWS, accounts_sql, line_items, oracle, totals_sql, view
from filingspark.sources import readers, sinks
from filingspark.streaming import jobs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


ITEMS = f"with {accounts_sql()}"
TOTALS = f"{ITEMS}, {totals_sql()}"
_in = lambda names: ", ".join(f"'{n}'" for n in names)


def _key(col: str) -> str:
    return f"replace(replace(lower(trim({col})), ' ', '_'), '-', '_')"


def _metric_cte() -> str:
    cols = []
    for kind, aliases in dims.METRIC_ALIASES.items():
        hit = f"statement_type = '{dims.METRIC_STATEMENT[kind]}' and value_current is not null and ({_key('name_norm')} in ({_in(aliases)}) or {_key('name_raw')} in ({_in(aliases)}))"
        for field in ("value_current", "value_prior"):
            cols.append(f"list(case when {field} is null then 'NaN'::double else {field} end order by item_ord) filter ({hit})[1] as {kind}_{field[6:]}")
        cols.append(f"list(case when page is null then 65e-2 else ref_confidence end order by item_ord) filter ({hit})[1] as {kind}_conf")
        cols.append(f"list(coalesce(page, -1) order by item_ord) filter ({hit})[1] as {kind}_page")
    cols = [c.replace("list(", "(list(").replace("[1] as", ")[1] as") for c in cols]
    return f"w as (select doc_id, {', '.join(cols)} from items group by doc_id)"


CORE = f"""{ITEMS}, {_metric_cte()}, m as (
  select doc_id, 'revenue_growth' as metric, case when not isnan(revenue_prior) and revenue_prior <> 0 then round_even((revenue_current - revenue_prior) / abs(revenue_prior), 6) end as value, revenue_conf as confidence, revenue_page as source_page from w
  union all select doc_id, 'net_profit_growth', case when not isnan(net_profit_prior) and net_profit_prior <> 0 then round_even((net_profit_current - net_profit_prior) / abs(net_profit_prior), 6) end, net_profit_conf, net_profit_page from w
  union all select doc_id, 'gross_margin', case when revenue_current <> 0 then round_even(coalesce(gross_profit_current, revenue_current - cogs_current) / revenue_current, 6) end, revenue_conf, revenue_page from w
  union all select doc_id, 'operating_cash_flow', round_even(operating_cash_current, 2), operating_cash_conf, operating_cash_page from w
  union all select doc_id, 'debt_ratio', case when total_assets_current <> 0 then round_even(total_liabilities_current / total_assets_current, 6) end, total_liabilities_conf, total_liabilities_page from w)
select doc_id, metric, value, confidence, nullif(source_page, -1) as source_page from m where value is not null"""


@query("core_metrics", oracle(CORE, "v_line_items"))
def core_metrics(spark: SparkSession, d: str) -> DataFrame:
    return export.core_metrics(line_items(spark, d))


@query("account_names", oracle(f"{ITEMS} select name_norm, statement_type, count(*) as n, count(value_current) as n_values from items group by all", "v_line_items"))
def account_names(spark: SparkSession, d: str) -> DataFrame:
    return line_items(spark, d).groupBy("name_norm", "statement_type").agg(F.count("*").alias("n"), F.count("value_current").alias("n_values"))


@query("statement_totals", oracle(f"{TOTALS} select * from totals", "v_line_items"))
def statement_totals(spark: SparkSession, d: str) -> DataFrame:
    return statements.statement_totals(line_items(spark, d))


@query("statement_snapshot", oracle(f"{TOTALS} select doc_id, string_agg(concat(statement_type, '.', concept), ',' order by concat(statement_type, '.', concept)) as keys, count(*) as n, round(sum(value), 2) as total from totals group by doc_id", "v_line_items"))
def statement_snapshot(spark: SparkSession, d: str) -> DataFrame:
    t = statements.statement_totals(line_items(spark, d))
    snapshot = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws(".", "statement_type", "concept"), "value"))))
    return t.groupBy("doc_id").agg(snapshot.alias("s"), F.count("*").alias("n")).select("doc_id", F.array_join(F.map_keys("s"), ",").alias("keys"), "n", F.round(F.aggregate(F.map_values("s"), F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


@query("find_total", oracle(f"""{TOTALS}, both_ as (select doc_id, statement_type, concept, value, -1 as o from totals union all select doc_id, statement_type, name_norm, value_current, item_ord from items where value_current is not null)
select doc_id, arg_min(value, o) filter (statement_type = 'income' and concept = 'cost_of_goods_sold') as cogs, arg_min(value, o) filter (statement_type = 'income' and concept = 'revenue') as revenue from both_ group by doc_id""", "v_line_items"))
def find_total(spark: SparkSession, d: str) -> DataFrame:
    i = line_items(spark, d)
    return statements.find_totals(i, statements.statement_totals(i), {"cogs": ("income", "cost_of_goods_sold"), "revenue": ("income", "revenue")})


def _facts(spark: SparkSession, d: str) -> DataFrame:
    i = line_items(spark, d)
    # Totals of a source that lacks some items: revenue items of a few suppliers are dropped.
    shown = i.where("not (supplier % 10 = 3 and item_ord = 1)")
    return facts.build_facts(shown, statements.statement_totals(i), view(spark, d, "v_statements"))


FACTS = f"""{TOTALS}, shown as (select * from items where not (supplier % 10 = 3 and item_ord = 1)), kept as (select * from shown where value_current is not null or page is not null),
raw as (
  select doc_id, statement_type, name_norm as concept, name_raw as label, value_current as value, unit, currency, page, ref_confidence, engine, 'line_item' as origin, item_ord as fact_ord from kept
  union all select doc_id, statement_type, concept, concept, value, null, null, null, null, null, 'statement_totals', 1000000 from totals t
  where not exists (select 1 from kept k where k.doc_id = t.doc_id and k.statement_type = t.statement_type and k.name_norm = t.concept)
), facts as (
  select r.doc_id, concat('fact_', substr(sha1(concat_ws('|', r.doc_id, r.statement_type, concept, cast(period_end as varchar), label)), 1, 16)) as fact_id, r.statement_type, concept, label, value, unit,
    case when unit like '%million%' then 1e6::double when unit like '%thousand%' then 1e3::double end as scale, currency, period_start, period_end,
    case when r.statement_type = 'balance' then 'instant' else 'duration' end as period_type,
    case when page is null then confidence else ref_confidence end as confidence, case when page is not null then engine end as extraction_engine, page is not null as cited, origin, fact_ord,
    case when concept = 'operating_cf' then 'operating_cash_flow' else concept end as canon
  from raw r left join v_statements s on r.doc_id = s.doc_id and r.statement_type = s.statement_type
)"""


@query("facts", oracle(f"{FACTS} select doc_id, fact_id, statement_type, concept, label, value, unit, scale, currency, period_end, period_type, confidence, extraction_engine, origin from facts", "v_line_items", "v_statements"))
def facts_query(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d).select("doc_id", "fact_id", "statement_type", "concept", "label", "value", "unit", "scale", "currency", "period_end", "period_type", "confidence", "extraction_engine", "origin")


def _corrections(spark: SparkSession, d: str) -> DataFrame:
    """Corrections by users: each concerns the facts of a supplier of that number."""
    return _corrections_of(spark, d, view(spark, d, "v_corrections"))


def _corrections_of(spark: SparkSession, d: str, c: DataFrame) -> DataFrame:
    f = _facts(spark, d).where("fact_ord in (2, 8)").select("fact_id", F.regexp_extract("doc_id", r"^d(\d+)-", 1).cast("long").alias("user_id"))
    raw = F.when(F.col("field_name") == "value", F.when(F.col("corr_ord") % 5 == 0, "\"oops\"").otherwise(F.col("corr_ord").cast("string"))).when(F.col("field_name") == "label", F.concat(F.lit('"L'), F.col("corr_ord").cast("string"), F.lit('"'))).otherwise("null")
    return f.join(c, "user_id").select("fact_id", "corr_ord", "field_name", raw.alias("new_value"))


CORRECTED = f"""{FACTS}, corr as (select f.fact_id, corr_ord, field_name from facts f join v_corrections c on cast(regexp_extract(f.doc_id, '^d(\\d+)-', 1) as bigint) = c.user_id where fact_ord in (2, 8)),
fold as (select fact_id, count(*) filter (field_name in ('value', 'label', 'evidence')) as n,
  max(corr_ord) filter (field_name = 'value' and corr_ord % 5 <> 0) as v, max(corr_ord) filter (field_name = 'label') as l from corr group by fact_id)"""


@query("effective_facts", oracle(f"{CORRECTED} select f.doc_id, f.fact_id, coalesce(cast(v as double), value) as value, case when l is not null then concat('L', cast(l as varchar)) else label end as label, coalesce(n, 0) as n_corrections from facts f left join fold using (fact_id)", "v_line_items", "v_statements", "v_corrections"))
def effective_facts(spark: SparkSession, d: str) -> DataFrame:
    return facts.corrected_facts(_facts(spark, d), _corrections(spark, d)).select("doc_id", "fact_id", "value", "label", "n_corrections")


@query("correction_counts", oracle(f"{CORRECTED} select fact_id, count(*) as n, max(corr_ord) as latest from corr group by fact_id", "v_line_items", "v_statements", "v_corrections"))
def correction_counts(spark: SparkSession, d: str) -> DataFrame:
    return _corrections(spark, d).groupBy("fact_id").agg(F.count("*").alias("n"), F.max("corr_ord").alias("latest"))


HISTORY = f"""{CORRECTED}, known as (select * from corr where field_name in ('value', 'label', 'evidence')),
valid as (select *, (field_name = 'value' and corr_ord % 5 <> 0) or field_name = 'label' as applied from known),
history as (select v.fact_id, corr_ord, field_name as field, applied, max(corr_ord) filter (applied) over (partition by v.fact_id, field_name order by corr_ord rows between unbounded preceding and 1 preceding) as before,
  row_number() over (partition by v.fact_id order by corr_ord desc) as place, f.value, f.label from valid v join facts f using (fact_id))
select fact_id, corr_ord, case field when 'evidence' then 'source_refs' else field end as field, applied, {{place}} case field when 'value' then round(coalesce(cast(before as double), value), 4) end as old_number,
  case field when 'label' then coalesce('L' || cast(before as varchar), label) end as old_text from history"""


def _shown(history: DataFrame, *more: str) -> DataFrame:
    plain = F.regexp_replace("old_value", r'^"|"$', "")
    number = F.when(F.col("field") == "value", F.round(F.nullif(plain, F.lit("null")).cast("double"), 4))
    return history.select("fact_id", "corr_ord", "field", "applied", *more, number.alias("old_number"), F.when(F.col("field") == "label", plain).alias("old_text"))


@query("correction_history", oracle(HISTORY.format(place="cast(place as int) as place,"), "v_line_items", "v_statements", "v_corrections"))
def correction_history(spark: SparkSession, d: str) -> DataFrame:
    """Every correction of the log with the value before it, a fact's newest first."""
    return _shown(facts.history(_corrections(spark, d), _facts(spark, d)), "place")


@query("stream_corrections", oracle(HISTORY.format(place=""), "v_line_items", "v_statements", "v_corrections"))
def stream_corrections(spark: SparkSession, d: str) -> DataFrame:
    """The same history, as a stream of the log's rows makes it."""
    events = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    log = spark.sql(VIEWS["v_corrections"], events=events)
    checked = facts.checked_corrections(_corrections_of(spark, d, log), _facts(spark, d))
    return _shown(jobs.finished(jobs.correction_stream(checked), "append"))


_FIND = """find_ as (select doc_id, {cols} from (select doc_id, statement_type, concept, value, -1 as o from totals union all select doc_id, statement_type, name_norm, value_current, item_ord from items where value_current is not null) b group by doc_id)"""
_COLS = ", ".join(f"arg_min(value, o) filter (statement_type = '{k}' and concept = '{c}') as {n}" for n, (k, c) in validate._TOTALS.items())
_NAME = "lower(concat(name_raw, ' ', name_norm))"
_GROW = f"""g as (select doc_id,
  (list(coalesce((value_current - value_prior) / greatest(abs(value_prior), 1.0), 'NaN'::double) order by item_ord) filter (statement_type = 'balance' and {_NAME} like '%accounts receivable%'))[1] as ar,
  (list(coalesce((value_current - value_prior) / greatest(abs(value_prior), 1.0), 'NaN'::double) order by item_ord) filter (statement_type = 'income' and {_NAME} like '%revenue%'))[1] as rev from items group by doc_id)"""
CHECKED = f"""{TOTALS}, {_FIND.format(cols=_COLS)}, {_GROW}, units as (select doc_id, statement_type, string_agg(distinct unit, ',' order by unit) as u from items group by all having count(distinct unit) > 1),
issues as (
  select doc_id, 'balance_equation_failed' as issue from find_ where abs(assets - (liabilities + equity)) / greatest(assets, 1.0) >= 0.02
  union all select doc_id, 'balance_missing_totals' from find_ where assets is null or liabilities is null or equity is null
  union all select doc_id, concat('income_missing:', concat_ws(',', case when revenue is null then 'revenue' end, case when gross is null then 'gross_profit' end, case when net_income is null then 'net_income' end)) from find_ where revenue is null or gross is null or net_income is null
  union all select doc_id, 'line_total_mismatch:gross_profit' from find_ where abs(revenue - cogs - gross) / greatest(abs(revenue), 1.0) > 0.05
  union all select doc_id, concat('unit_mismatch:', u) from units)"""


def _profile(spark: SparkSession, d: str) -> DataFrame:
    return validate.profile(line_items(spark, d))


@query("statement_issues", oracle(f"{CHECKED} select * from issues", "v_line_items"))
def statement_issues(spark: SparkSession, d: str) -> DataFrame:
    return validate.statement_issues(_profile(spark, d))


@query("statement_metrics", oracle(f"""{CHECKED} select doc_id, metric, round(value, 6) as value from (
  select doc_id, 'balance_equation' as metric, abs(assets - (liabilities + equity)) / greatest(assets, 1.0) as value from find_ where assets is not null and liabilities is not null and equity is not null
  union all select doc_id, 'profit_to_cfo_ratio', operating_cf / greatest(abs(net_income), 1e-6) from find_ where operating_cf is not null and net_income is not null
  union all select doc_id, 'ar_growth_vs_rev_growth', ar - rev from g where not isnan(ar) and not isnan(rev)) m""", "v_line_items"))
def statement_metrics(spark: SparkSession, d: str) -> DataFrame:
    return validate.statement_metrics(_profile(spark, d)).withColumn("value", F.round("value", 6))


_VALS = ", ".join(f"arg_min(value, fact_ord) filter (value is not null and statement_type = '{k}' and canon = '{c}') as {n}" for n, (k, c) in validate._FACTS.items())
_CRIT = " union all ".join(f"select '{k}' as statement_type, '{c}' as canon, {n} as o" for k, cs in dims.CRITICAL.items() for n, c in enumerate(cs))
FACT_ISSUES = f"""{FACTS}, crit as ({_CRIT}), kinds as (select distinct doc_id, statement_type from facts), v as (select doc_id, bool_or(statement_type = 'balance') as hb, bool_or(statement_type = 'cashflow') as hc, {_VALS} from facts group by doc_id),
per as (select doc_id, statement_type, count(distinct period_end) as ends, count(distinct currency) as cur, string_agg(distinct currency, ',' order by currency) as curs, count(currency) as ncur, count(distinct scale) as sc, count(scale) as nsc, count(*) as n from facts group by all),
fact_issues as (
  select doc_id, 'missing_critical_facts' as code, 'high' as severity, statement_type, 0 as n_facts, string_agg(canon, ',' order by o) as detail from (select k.doc_id, k.statement_type, c.canon, c.o from kinds k join crit c using (statement_type)) x
    where not exists (select 1 from facts f where f.doc_id = x.doc_id and f.statement_type = x.statement_type and f.canon = x.canon) group by doc_id, statement_type
  union all select doc_id, 'period_inconsistency', 'high', statement_type, n, null from per where ends > 1
  union all select doc_id, 'currency_inconsistency', 'medium', statement_type, ncur, curs from per where cur > 1
  union all select doc_id, 'scale_inconsistency', 'medium', statement_type, nsc, null from per where sc > 1
  union all select doc_id, 'duplicate_concepts', 'medium', statement_type, count(*), canon from facts group by doc_id, statement_type, canon, period_start, period_end having count(*) > 1
  union all select doc_id, 'missing_source_refs', 'high', statement_type, count(*), canon from facts f join crit c using (statement_type, canon) group by doc_id, statement_type, canon having not bool_or(cited)
  union all select doc_id, 'balance_equation_missing_facts', 'high', 'balance', 0, null from v where hb and (assets is null or liabilities is null or equity is null)
  union all select doc_id, 'balance_equation_failed', 'high', 'balance', 0, null from v where hb and abs(assets - (liabilities + equity)) / greatest(abs(assets), 1.0) >= 0.02
  union all select doc_id, 'cashflow_reconciliation_missing_facts', 'medium', 'cashflow', 0, null from v where hc and (ocf is null or capex is null)
  union all select doc_id, 'cashflow_reconciliation_failed', 'medium', 'cashflow', 0, null from v where hc and ocf is not null and capex > 0)"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_statements").select("doc_id").distinct()


@query("fact_issues", oracle(f"{FACT_ISSUES} select doc_id, code, severity, statement_type, cast(n_facts as bigint) as n_facts, detail from fact_issues", "v_line_items", "v_statements"))
def fact_issues(spark: SparkSession, d: str) -> DataFrame:
    i = validate.validate_facts(_docs(spark, d), _facts(spark, d))
    # The facts of an equation are named by fact_issue_ids, not counted here.
    counted = F.when(F.col("code").rlike("^(balance_equation|cashflow_reconciliation)"), F.lit(0).cast("long")).otherwise(F.col("n_facts"))
    return i.select("doc_id", "code", "severity", "statement_type", counted.alias("n_facts"), "detail")


_PAIRS = ", ".join(f"('{code}', '{c}')" for code, names in (("balance_equation_failed", ("total_assets", "total_liabilities", "total_equity")), ("balance_equation_missing_facts", ("total_assets", "total_liabilities", "total_equity")), ("cashflow_reconciliation_failed", ("operating_cash_flow", "capex")), ("cashflow_reconciliation_missing_facts", ("operating_cash_flow", "capex"))) for c in names)


@query("fact_issue_ids", oracle(f"""{FACT_ISSUES}, about as (select i.doc_id, i.code, i.statement_type, i.detail, f.fact_id from fact_issues i join facts f on f.doc_id = i.doc_id and f.statement_type = i.statement_type where
  i.code = 'period_inconsistency' or (i.code = 'currency_inconsistency' and f.currency <> '') or (i.code = 'scale_inconsistency' and f.scale is not null) or (i.code in ('duplicate_concepts', 'missing_source_refs') and f.canon = i.detail)
  or (i.code, f.canon) in ({_PAIRS}))
select doc_id, code, statement_type, detail, string_agg(fact_id, ',' order by fact_id) as fact_ids from about group by all""", "v_line_items", "v_statements"))
def fact_issue_ids(spark: SparkSession, d: str) -> DataFrame:
    i = validate.fact_issues(validate.fact_profile(_docs(spark, d), _facts(spark, d))).where("size(fact_ids) > 0")
    return i.select("doc_id", "code", "statement_type", "detail", F.array_join(F.array_sort("fact_ids"), ",").alias("fact_ids"))


@query("fact_metrics", oracle(f"""{FACT_ISSUES} select d.doc_id, count(fact_id) as fact_count, count(*) filter (cited) as facts_with_source_refs, count(fact_id) > 0 as facts_present,
  round(max(case when hb then abs(assets - (liabilities + equity)) / greatest(abs(assets), 1.0) end), 6) as balance_equation_diff_ratio, round(max(case when hc then ocf + capex end), 2) as free_cash_flow
from (select distinct doc_id from v_statements) d left join facts f using (doc_id) left join v using (doc_id) group by d.doc_id""", "v_line_items", "v_statements"))
def fact_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = validate.fact_metrics(validate.fact_profile(_docs(spark, d), _facts(spark, d)))
    return m.withColumns({"balance_equation_diff_ratio": F.round("balance_equation_diff_ratio", 6), "free_cash_flow": F.round("free_cash_flow", 2)})


_CHECKS = " union all ".join(f"select {n} as n, '{check}' as \"check\", '{code}' as code" for n, (check, codes) in enumerate(validate.CHECKS.items()) for code in codes)


@query("fact_checks", oracle(f"""{FACT_ISSUES}, checks as ({_CHECKS}), applies as (select v.doc_id, c."check", c.code from v cross join checks c where case c."check" when 'balance_equation' then hb when 'cashflow_reconciliation' then hc else true end)
select a.doc_id, a."check", count(i.code) = 0 as passed from applies a left join fact_issues i on i.doc_id = a.doc_id and i.code = a.code group by all""", "v_line_items", "v_statements"))
def fact_checks(spark: SparkSession, d: str) -> DataFrame:
    return validate.fact_checks(validate.fact_profile(_docs(spark, d), _facts(spark, d)))


_GATE = FACT_ISSUES + ", " + CHECKED[len(TOTALS) + 2 :]


@query("validation_gate", oracle(f"{_GATE} select doc_id, exists(select 1 from issues i where i.doc_id = d.doc_id and (issue in ('balance_equation_failed', 'balance_missing_totals') or issue like 'unit_mismatch%')) or exists(select 1 from fact_issues i where i.doc_id = d.doc_id and severity = 'high') as severe from (select distinct doc_id from v_statements) d", "v_line_items", "v_statements"))
def validation_gate(spark: SparkSession, d: str) -> DataFrame:
    return validate.gate(_docs(spark, d), statement_issues(spark, d), fact_issues(spark, d))


SIGNALS = f"""{CHECKED}, sig as (
  select doc_id, 'cash_vs_profit' as category, case when abs(operating_cf) > abs(net_income) then 'high' else 'medium' end as severity from find_ where net_income > 0 and operating_cf < 0
  union all select doc_id, 'working_capital', 'medium' from g where not isnan(ar) and not isnan(rev) and ar - rev > 0.2
  union all select distinct doc_id, 'disclosure_inconsistency', 'high' from issues where issue in ('balance_equation_failed', 'balance_missing_totals') or issue like 'unit_mismatch%')"""


def _signals(spark: SparkSession, d: str) -> DataFrame:
    return signals.signals(_profile(spark, d))


_TITLES = """case category when 'cash_vs_profit' then 'Positive profit with negative operating cashflow' when 'working_capital' then 'Receivables growth outpaces revenue' else 'Statement reconciliation issues' end"""
SIGNAL_ROWS = f"""{SIGNALS}, cited as (select doc_id, statement_type, arg_min(name_raw, item_ord) as quote from items where page is not null group by all),
rows_ as (select s.*, {_TITLES} as title, case category when 'cash_vs_profit' then 'Net income is positive while operating cashflow is negative.' when 'working_capital' then 'Accounts receivable growth exceeds revenue growth.' else 'Balance equation or unit consistency checks failed.' end as description,
  case category when 'cash_vs_profit' then round(f.net_income, 4) when 'working_capital' then round(ar, 6) end as first_metric, case category when 'cash_vs_profit' then round(f.operating_cf, 4) when 'working_capital' then round(rev, 6) end as second_metric,
  case category when 'disclosure_inconsistency' then (select string_agg(issue, ',' order by issue) from issues i where i.doc_id = s.doc_id) end as named_issues,
  case when category = 'disclosure_inconsistency' then 'Evidence unavailable' else coalesce(c.quote, 'Evidence unavailable') end as evidence
from sig s left join find_ f using (doc_id) left join g using (doc_id) left join cited c on c.doc_id = s.doc_id and c.statement_type = case s.category when 'cash_vs_profit' then 'cashflow' else 'balance' end)"""


@query("risk_signals", oracle(f"{SIGNAL_ROWS} select doc_id, category, severity, title, description, first_metric, second_metric, named_issues, evidence, concat('sig_', substr(sha1(concat_ws('|', doc_id, category, title)), 1, 16)) as signal_id from rows_", "v_line_items"))
def risk_signals(spark: SparkSession, d: str) -> DataFrame:
    m = lambda k, n: F.round(F.element_at("metrics", k).cast("double"), n)
    return _signals(spark, d).select(
        "doc_id", "category", "severity", "title", "description", F.coalesce(m("net_income", 4), m("ar_growth", 6)).alias("first_metric"), F.coalesce(m("operating_cf", 4), m("rev_growth", 6)).alias("second_metric"),
        F.element_at("metrics", "issues").alias("named_issues"), F.col("evidence")[0]["quote"].alias("evidence"), "signal_id",
    )


@query("severity_counts", oracle(f"{SIGNALS} select category, count(*) filter (severity = 'high') as n_high, count(*) filter (severity = 'medium') as n_medium, count(*) filter (severity = 'low') as n_low, count(distinct doc_id) as n_docs from sig group by category", "v_line_items"))
def severity_counts(spark: SparkSession, d: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s).alias(f"n_{s}")
    return _signals(spark, d).groupBy("category").agg(n("high"), n("medium"), n("low"), F.count_distinct("doc_id").alias("n_docs"))


@query("top_signals", oracle(f"{SIGNALS}, r as (select doc_id, category, severity, row_number() over (partition by doc_id order by case severity when 'high' then 3 when 'medium' then 2 else 1 end desc, category) as place from sig) select * from r where place <= 2", "v_line_items"))
def top_signals(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy(signals.rank(F.col("severity")).desc(), "category")
    s = _signals(spark, d).select("doc_id", "category", "severity", F.row_number().over(order).alias("place"))
    return s.where("place <= 2")


def _graded(spark: SparkSession, d: str) -> DataFrame:
    """Signals in the order of their categories, some of a severity of their own."""
    from pyspark.sql import Window

    odd = F.regexp_extract("doc_id", r"^d(\d+)-", 1).cast("long") % 2 == 1
    s = _signals(spark, d).withColumn("severity", F.when(odd & (F.col("category") == "working_capital"), "notable").otherwise(F.col("severity")))
    return s.withColumn("sig_ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("category")))


GRADED = f"""{SIGNALS}, graded as (select doc_id, category, case when category = 'working_capital' and cast(regexp_extract(doc_id, '^d(\\d+)-', 1) as bigint) % 2 = 1 then 'notable' else severity end as severity from sig)"""


@query("severity_summary", oracle(f"{GRADED} select doc_id, count(*) filter (severity = 'high') as high, count(*) filter (severity = 'medium') as medium, count(*) filter (severity = 'low') as low, count(*) filter (severity not in ('high', 'medium', 'low')) as other from graded group by doc_id", "v_line_items"))
def severity_summary(spark: SparkSession, d: str) -> DataFrame:
    return signals.severity_summary(_graded(spark, d))


@query("top_five_signals", oracle(f"{GRADED} select doc_id, category, severity, cast(row_number() over (partition by doc_id order by case severity when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end desc, category) as int) as place from graded qualify place <= 5", "v_line_items"))
def top_five_signals(spark: SparkSession, d: str) -> DataFrame:
    return signals.top(_graded(spark, d)).select("doc_id", "category", "severity", "place")


@query("event_prices", oracle("select e.ticker, e.event_date, p.trade_date, cast(p.close as double) as close from v_events e join v_prices p on p.ticker = e.ticker and p.trade_date between e.event_date - 15 and e.event_date + 15", "v_events", "v_prices"))
def event_prices(spark: SparkSession, d: str) -> DataFrame:
    """Prices around events, from a price table in folders by ticker and year."""
    folder = sinks.scratch(spark, "prices")
    sinks.write_prices(view(spark, d, "v_prices"), folder)
    near = readers.prices_near(spark.read.parquet(folder), view(spark, d, "v_events"), 15)
    return near.select("ticker", "event_date", "trade_date", F.col("close").cast("double").alias("close"))


@query("merged_signals", oracle(f"""{SIGNAL_ROWS} select substr(doc_id, 1, strpos(doc_id, '-') - 1) as doc_id, category, title, max(case severity when 'high' then 3 when 'medium' then 2 else 1 end) as severity_rank, min(doc_id) as signal_id, any_value(description) as description,
  arg_max(first_metric, doc_id) as first_metric, count(distinct evidence) as n_quotes from rows_ group by 1, 2, 3""", "v_line_items"))
def merged_signals(spark: SparkSession, d: str) -> DataFrame:
    """Signals of a supplier's filings, merged over the years."""
    from pyspark.sql import Window

    s = _signals(spark, d).withColumn("signal_id", F.col("doc_id")).withColumn("doc_id", F.substring_index("doc_id", "-", 1))
    s = s.withColumn("sig_ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("signal_id", "category")))
    m = signals.merge_signals(s)
    first = F.coalesce(F.round(F.element_at("metrics", "net_income").cast("double"), 4), F.round(F.element_at("metrics", "ar_growth").cast("double"), 6))
    quotes = F.size(F.array_distinct(F.transform("evidence", lambda r: r["quote"]))).cast("long")
    return m.select("doc_id", "category", "title", signals.rank(F.col("severity")).cast("int").alias("severity_rank"), "signal_id", "description", first.alias("first_metric"), quotes.alias("n_quotes"))


@query("period_labels", oracle("select doc_id, concat(cast(extract(year from period_end) as varchar), case extract(month from period_end) when 9 then 'Q3' else 'Q4' end) as period from v_statements where statement_type = 'income'", "v_statements"))
def period_labels(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "v_statements").where("statement_type = 'income'")
    return s.select("doc_id", dates.period_label(F.col("period_end"), F.lit("annual")).alias("period"))


@query("export_envelopes", oracle(f"""{CORE[: CORE.rindex("select doc_id, metric")]}, {SIGNALS[len(ITEMS) + 2 :]}, me as (select doc_id, string_agg(metric, ',' order by metric) as metrics, round(sum(value), 4) as total from m where value is not null group by doc_id),
se as (select doc_id, string_agg(concat(category, ':', severity), ',' order by category) as signals from sig group by doc_id)
select s.doc_id, s.doc_id as symbol, concat(cast(extract(year from period_end) as varchar), case extract(month from period_end) when 9 then 'Q3' else 'Q4' end) as period, coalesce(metrics, '') as metrics, total, coalesce(signals, '') as signals
from v_statements s left join me using (doc_id) left join se using (doc_id) where statement_type = 'income'""", "v_line_items", "v_statements"))
def export_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """The envelopes, read back from their JSON."""
    made = _envelopes(spark, d)
    shape = "struct<symbol:string,period:string,facts:array<struct<metric:string,value:double>>,risk_signals:array<struct<category:string,severity:string>>>"
    e = made.select("doc_id", F.from_json("export", shape).alias("e")).select("doc_id", "e.*")
    total = F.when(F.size("facts") > 0, F.round(F.aggregate("facts", F.lit(0.0), lambda a, f: a + f["value"]), 4))
    return e.select("doc_id", "symbol", "period", F.array_join("facts.metric", ",").alias("metrics"), total.alias("total"), F.array_join(F.transform("risk_signals", lambda s: F.concat_ws(":", s["category"], s["severity"])), ",").alias("signals"))


def _envelopes(spark: SparkSession, d: str) -> DataFrame:
    meta = view(spark, d, "v_statements").where("statement_type = 'income'").select("doc_id", "period_end", F.lit("10-K").alias("filing_type"))
    return export.envelopes(meta, core_metrics(spark, d), _signals(spark, d))


@query("best_metrics", oracle(f"{CORE[: CORE.rindex('select doc_id, metric')]} select doc_id, metric, confidence, value, source_page from (select split_part(doc_id, '-', 1) as doc_id, metric, confidence, value, nullif(source_page, -1) as source_page, row_number() over (partition by split_part(doc_id, '-', 1), metric order by confidence desc, doc_id) as n from m where value is not null) x where n = 1", "v_line_items"))
def best_metrics(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    m = core_metrics(spark, d).withColumn("yr", F.col("doc_id")).withColumn("doc_id", F.substring_index("doc_id", "-", 1))
    m = m.withColumn("metric_ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("yr", "metric")))
    return export.dedupe_metrics(m).select("doc_id", "metric", "confidence", "value", "source_page")


@query("grid_statements", oracle("""select doc_id, row + 1 as item_ord, name_raw, c as shown, case
   when c like '(%' then -cast(replace(substr(c, 2, length(c) - 2), ',', '') as double) when c like '%万' then cast(substr(c, 2, length(c) - 2) as double) * 10000
   when c like '%\\%' escape '\\' then cast(substr(c, 1, length(c) - 1) as double) / 100 else -cast(substr(c, 2) as double) end as value_current
 from (select doc_id, row, max(text) filter (col = 0) as name_raw, max(text) filter (col = 1) as c from v_cells group by doc_id, row) t""", "v_cells"))
def grid_statements(spark: SparkSession, d: str) -> DataFrame:
    at = lambda c: F.max(F.when(F.col("col") == c, F.col("text")))
    t = view(spark, d, "v_cells").groupBy("doc_id", "row").agg(at(0).alias("name_raw"), at(1).alias("shown"))
    return t.select("doc_id", (F.col("row") + 1).alias("item_ord"), "name_raw", "shown", numbers.parse_number(F.col("shown")).alias("value_current"))


_GRID = """rows_ as (select doc_id, row, max(text) filter (col = 0) as name_raw, max(text) filter (col = 1) as c, max(text) filter (col = 2) as p from v_cells group by doc_id, row),
kinds as (select doc_id from (select doc_id, lower(string_agg(text, ' ' order by row, col)) as t from v_cells where row < 3 group by doc_id) x where t like '%revenue%' or t like '%净利润%'),
grid as (select doc_id, row, name_raw, case
   when c like '(%' then -cast(replace(substr(c, 2, length(c) - 2), ',', '') as double) when c like '%万' then cast(substr(c, 2, length(c) - 2) as double) * 10000
   when c like '%\\%' escape '\\' then cast(substr(c, 1, length(c) - 1) as double) / 100 else -cast(substr(c, 2) as double) end as value_current from rows_ join kinds using (doc_id))"""


@query("table_statements", oracle(f"""with {_GRID}, {accounts_sql().split(", items as")[0]}
select doc_id, 'income' as statement_type, cast(row + 1 as int) as item_ord, name_raw, coalesce(l.concept, e.concept, trim(name_raw)) as name_norm, value_current, 't0' as table_id, name_raw as quote
from grid left join accounts l on lower(trim(name_raw)) = l.account left join accounts e on trim(name_raw) = e.account""", "v_cells"))
def table_statements(spark: SparkSession, d: str) -> DataFrame:
    ref = F.col("source_refs")[0]
    return statements.from_grids(view(spark, d, "v_cells")).select("doc_id", "statement_type", "item_ord", "name_raw", "name_norm", "value_current", ref["table_id"].alias("table_id"), ref["quote"].alias("quote"))


_PRINTED = (
    ("Total net sales", "Total net sales", "revenue"), ("Gross margin", "Gross margin", "gross_profit"), ("Operating income", "Operating income", "operating_income"), ("Net income", "Net income", "net_income"),
    ("Total assets", "Total Assets", "total_assets"), ("Total liabilities", "Total Liabilities", "total_liabilities"), ("Total shareholders' equity", "Total shareholders' equity", "total_equity"), ("Capital expenditures", "Capital expenditures", "capex"),
)
_SAID = ", ".join("({})".format(", ".join("'{}'".format(x.replace("'", "''")) for x in row)) for row in _PRINTED)


@query("text_statements", oracle(f"""select i.doc_id, i.statement_type, p.label as name_raw, p.concept as name_norm, floor(abs(i.value_current)) as value_current, case i.statement_type when 'income' then 1 when 'balance' then 2 else 3 end as page,
  case when p.concept <> 'revenue' then concat(p.printed, ': ', cast(cast(floor(abs(i.value_current)) as bigint) as varchar)) end as quote, case when i.supplier % 2 = 0 then '万元' else 'USD millions' end as unit, case when i.supplier % 2 = 0 then 'CNY' else 'USD' end as currency
from v_line_items i join (values {_SAID}) p(printed, label, concept) on i.name_raw = p.printed where i.value_current is not null""", "v_line_items"))
def text_statements(spark: SparkSession, d: str) -> DataFrame:
    pages = view(spark, d, "v_filing_pages")
    lang = F.when(F.regexp_extract("doc_id", r"^d(\d+)-", 1).cast("long") % 2 == 0, "zh").otherwise("en").alias("lang")
    items = statements.with_language_defaults(statements.from_pages(pages), pages.select("doc_id", lang).distinct())
    # A label that is printed twice, and what stands between two labels, is left to the tests.
    items = items.where(F.col("name_raw").isin(*[label for _, label, _ in _PRINTED]))
    return items.select("doc_id", "statement_type", "name_raw", "name_norm", "value_current", "page", F.when(F.col("name_norm") != "revenue", F.col("quote")).alias("quote"), "unit", "currency")


@query("statement_types", oracle("""select doc_id, case when t like '%revenue%' or t like '%净利润%' then 'income' end as statement_type from
 (select doc_id, lower(string_agg(text, ' ' order by row, col)) as t from v_cells where row < 3 group by doc_id) x""", "v_cells"))
def statement_types(spark: SparkSession, d: str) -> DataFrame:
    head = view(spark, d, "v_cells").where("row < 3").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row", "col", "text"))).alias("h"))
    joined = F.array_join(F.transform("h", lambda x: x["text"]), " ")
    return head.select("doc_id", text.statement_type(F.lit(None).cast("string"), joined).alias("statement_type"))


_ROUND = ("cumulative_return", "std_dev", "mean_volume", "alpha", "beta", "car", "mean_ar", "t_stat")


def _prices(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(view(spark, d, v).withColumn("close", F.col("close").cast("double")) if v != "v_events" else view(spark, d, v) for v in ("v_prices", "v_bench", "v_events"))


STUDY = """with s as (select ticker, trade_date, cast(close as double) as close, volume, row_number() over (partition by ticker order by trade_date) - 1 as idx,
  coalesce(cast(close as double) / lag(cast(close as double)) over (partition by ticker order by trade_date) - 1, 0) as ret from v_prices),
b as (select trade_date, coalesce(cast(close as double) / lag(cast(close as double)) over (order by trade_date) - 1, 0) as bm from v_bench),
e as (select v.ticker, event_date, coalesce(min(idx) filter (trade_date >= event_date), min(idx)) as ei, min(idx) filter (trade_date >= event_date) is not null as event_matched from v_events v join s using (ticker) group by v.ticker, event_date),
w as (select e.*, pre, post, greatest(ei + pre - 1, 0) as ee from e cross join (values (-1, 1), (-3, 3), (-5, 5)) t(pre, post)),
r as (select w.*, s.idx, s.close, s.volume, s.ret, b.bm, idx between ei + pre and ei + post as i, idx >= greatest(ee - 120, 0) and idx < ee and bm is not null as est from w join s using (ticker) left join b using (trade_date)),
i as (select ticker, event_date, pre, post, close, idx, coalesce(close / lag(close) over (partition by ticker, event_date, pre, post order by idx) - 1, 0) as wret from r where i),
sd as (select ticker, event_date, pre, post, stddev_samp(wret) as std_dev from i group by all),
a as (select ticker, event_date, pre, post, event_matched, arg_max(close, idx) filter (i) / arg_min(close, idx) filter (i) - 1 as cumulative_return, avg(volume) filter (i) as mean_volume, max(volume) filter (i) as max_volume,
  case when count(*) filter (est) >= 20 and var_pop(bm) filter (est) >= 1e-12 then covar_pop(ret, bm) filter (est) / var_pop(bm) filter (est) end as beta, avg(ret) filter (est) as my, avg(bm) filter (est) as mx from r group by all),
ar as (select r.ticker, r.event_date, r.pre, r.post, r.ret - (my - beta * mx) - beta * bm as ar from r join a using (ticker, event_date, pre, post) where r.i and bm is not null and beta is not null),
t as (select ticker, event_date, pre, post, sum(ar) as car, avg(ar) as mean_ar, case when count(*) < 2 or stddev_samp(ar) < 1e-12 then 0 else avg(ar) / (stddev_samp(ar) / sqrt(count(*))) end as t_stat from ar group by all)
select ticker, event_date, pre, post, event_matched, round(cumulative_return, 6) as cumulative_return, round(std_dev, 6) as std_dev, round(mean_volume, 6) as mean_volume, max_volume, round(my - beta * mx, 6) as alpha, round(beta, 6) as beta, round(car, 6) as car, round(mean_ar, 6) as mean_ar, round(t_stat, 6) as t_stat
from a join sd using (ticker, event_date, pre, post) left join t using (ticker, event_date, pre, post)"""


@query("event_study", oracle(STUDY, "v_prices", "v_bench", "v_events"))
def event_study(spark: SparkSession, d: str) -> DataFrame:
    out = es.event_study(*_prices(spark, d)).drop("p_value")
    return out.select(*[F.round(c, 6).alias(c) if c in _ROUND else F.col(c) for c in out.columns])


_ERFC = "(tt * (254829592e-9 + tt * (-284496736e-9 + tt * (1421413741e-9 + tt * (-1453152027e-9 + tt * 1061405429e-9)))) * exp(-z * z))"


@query("event_significance", oracle(f"""{STUDY[: STUDY.rindex("select ticker, event_date, pre, post, event_matched, round")]}, p as (select ticker, event_date, pre, post, t_stat, abs(t_stat) / sqrt(2e0) as z, 1e0 / (1e0 + 3275911e-7 * abs(t_stat) / sqrt(2e0)) as tt from a left join t using (ticker, event_date, pre, post))
select ticker, event_date, pre, post, round(t_stat, 6) as t_stat, round({_ERFC}, 6) as p_value from p""", "v_prices", "v_bench", "v_events"))
def event_significance(spark: SparkSession, d: str) -> DataFrame:
    return es.event_study(*_prices(spark, d)).select("ticker", "event_date", "pre", "post", F.round("t_stat", 6).alias("t_stat"), F.round("p_value", 6).alias("p_value"))


@query("price_index", oracle("""with p as (select ticker, trade_date, cast(close as double) as close from v_prices), b as (select trade_date as bd, cast(close as double) as bc from v_bench),
n as (select ticker, trade_date, close, (select arg_min(bc, abs(date_diff('day', bd, trade_date)) * 100000 - date_diff('day', date '1970-01-01', bd)) from b) as bm from p)
select ticker, trade_date, round(close / first_value(close) over w * 100, 6) as stock_index, round(bm / first_value(bm) over w * 100, 6) as bench_index from n window w as (partition by ticker order by trade_date)""", "v_prices", "v_bench"))
def price_index(spark: SparkSession, d: str) -> DataFrame:
    p, b, _ = _prices(spark, d)
    return es.indexed_to_100(p, b).select("ticker", "trade_date", F.round("stock_index", 6).alias("stock_index"), F.round("bench_index", 6).alias("bench_index"))


@query("price_range", oracle("select v.ticker, event_date, count(*) as n, min(trade_date) as first_day, max(trade_date) as last_day from v_events v join v_prices p on p.ticker = v.ticker and trade_date between event_date - 150 and event_date + 10 group by all", "v_prices", "v_events"))
def price_range(spark: SparkSession, d: str) -> DataFrame:
    p, _, e = _prices(spark, d)
    near = F.col("trade_date").between(F.date_sub("event_date", 150), F.date_add("event_date", 10))
    return e.join(p, "ticker").where(near).groupBy("ticker", "event_date").agg(F.count("*").alias("n"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"))
