"""Validation of statements and facts.

Each is one aggregation, a profile by document or by document and statement;
issues, metrics, checks and signals are projections of it, so that line items and
facts are read once. What is collected is one statement's facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingspark import dims
from filingspark.functions import numbers
from filingspark.operators.statements import found_total, named

TOLERANCE = 0.02
_TOTALS = {
    "assets": ("balance", "total_assets"), "liabilities": ("balance", "total_liabilities"), "equity": ("balance", "total_equity"),
    "revenue": ("income", "revenue"), "cogs": ("income", "cost_of_goods_sold"), "gross": ("income", "gross_profit"),
    "net_income": ("income", "net_income"), "operating_cf": ("cashflow", "operating_cf"),
}
_FACTS = {
    "assets": ("balance", "total_assets"), "liabilities": ("balance", "total_liabilities"), "equity": ("balance", "total_equity"),
    "ocf": ("cashflow", "operating_cash_flow"), "capex": ("cashflow", "capex"),
}


def profile(items: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """A row per document with all that statement checks and signals ask for, from
    one aggregation: totals (given ones, else the last of each concept, else the
    first line item), the kinds of statements, pairs of values of named items, the
    units of each statement and the first evidence of a statement."""
    first = lambda x, hit: F.min_by(F.when(hit, x), F.when(hit, F.col("item_ord")))
    kind = F.col("statement_type")
    rows = items
    if totals is not None:  # given totals stand before all line items
        given = totals.select("doc_id", "statement_type", F.col("concept").alias("name_norm"), F.col("value").alias("value_current"), F.lit(-1).alias("item_ord"))
        rows = items.unionByName(given, allowMissingColumns=True)

    def of(matches: Column, name: str) -> Column:
        return first(F.struct("value_current", "value_prior"), matches & (F.col("item_ord") >= 0)).alias(name)

    cited = F.coalesce(F.size("source_refs"), F.lit(0)) > 0
    return rows.groupBy("doc_id").agg(
        *[found_total(k, c, totals is None).alias(name) for name, (k, c) in _TOTALS.items()],
        *[F.bool_or(kind == k).alias(f"has_{k}") for k in dims.CRITICAL],
        of(named("balance", "应收", "accounts receivable"), "ar"), of(named("income", "营业收入", "revenue"), "rev"), of(named("balance", "存货", "inventory"), "inv"),
        F.collect_set(F.when(F.col("unit") != "", F.struct("statement_type", "unit"))).alias("units"),
        *[first(F.col("source_refs"), (kind == k) & cited).alias(f"{k}_refs") for k in ("balance", "cashflow")],
    ).transform(_with_growths).transform(_with_issues)


def _with_growths(p: DataFrame) -> DataFrame:
    rate = lambda x: numbers.growth(F.col(f"{x}.value_current"), F.col(f"{x}.value_prior"))
    return p.withColumns({"ar_growth": rate("ar"), "rev_growth": rate("rev"), "inventory_growth": rate("inv")}).drop("ar", "rev", "inv")


def _with_issues(p: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds ``off``, how far the balance equation fails, and ``issues``."""
    whole = F.col("assets").isNotNull() & F.col("liabilities").isNotNull() & F.col("equity").isNotNull()
    off = F.abs(F.col("assets") - (F.col("liabilities") + F.col("equity"))) / F.greatest(F.col("assets"), F.lit(1.0))
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(n)) for c, n in (("revenue", "revenue"), ("gross", "gross_profit"), ("net_income", "net_income"))]))
    gap = F.abs(F.col("revenue") - F.col("cogs") - F.col("gross")) / F.greatest(F.abs(F.col("revenue")), F.lit(1.0))
    found = F.array_compact(
        F.array(
            F.when(F.col("has_balance") & whole & (off >= tolerance), "balance_equation_failed"),
            F.when(F.col("has_balance") & ~whole, "balance_missing_totals"),
            F.when(F.col("has_income") & (F.size(missing) > 0), F.concat(F.lit("income_missing:"), F.array_join(missing, ","))),
            F.when(F.col("has_income") & (gap > 0.05), "line_total_mismatch:gross_profit"),
        )
    )
    kinds = F.array_sort(F.array_distinct(F.transform("units", lambda u: u["statement_type"])))
    of_kind = F.transform(kinds, lambda k: F.array_sort(F.transform(F.filter("units", lambda u: u["statement_type"] == k), lambda u: u["unit"])))
    mixed = F.transform(F.filter(of_kind, lambda u: F.size(u) > 1), lambda u: F.concat(F.lit("unit_mismatch:"), F.array_join(u, ",")))
    return p.withColumns({"off": F.when(F.col("has_balance") & whole, off), "issues": F.concat(found, mixed)})


def validate_statements(items: DataFrame, totals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(issues, metrics): (doc_id, issue) and (doc_id, metric, value)."""
    p = profile(items, totals)
    return statement_issues(p), statement_metrics(p)


def statement_issues(p: DataFrame) -> DataFrame:
    """(doc_id, issue) of a profile."""
    return p.select("doc_id", F.explode("issues").alias("issue"))


def statement_metrics(p: DataFrame) -> DataFrame:
    """(doc_id, metric, value) of a profile."""
    both = F.col("net_income").isNotNull() & F.col("operating_cf").isNotNull()
    entry = lambda name, value: F.struct(F.lit(name).alias("metric"), value.alias("value"))
    found = F.array(
        entry("balance_equation", F.col("off")),
        entry("profit_to_cfo_ratio", F.when(both, F.col("operating_cf") / F.greatest(F.abs("net_income"), F.lit(1e-6)))),
        entry("ar_growth_vs_rev_growth", F.col("ar_growth") - F.col("rev_growth")),
    )
    return p.select("doc_id", F.explode(F.filter(found, lambda m: m["value"].isNotNull())).alias("m")).select("doc_id", "m.*")


def validation_results(p: DataFrame) -> DataFrame:
    """(doc_id, issues, checks, metrics) of a profile, a row per document: ``checks`` holds how far the balance equation
    fails where its three totals are known, ``metrics`` the ratios of two statements; both maps may be empty."""
    both = F.col("net_income").isNotNull() & F.col("operating_cf").isNotNull()
    given = lambda **values: F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("double").alias("value")) for k, v in values.items()]), lambda e: e["value"].isNotNull()))
    ratio = F.when(both, F.col("operating_cf") / F.greatest(F.abs("net_income"), F.lit(1e-6)))
    return p.select("doc_id", "issues", given(balance_equation=F.col("off")).alias("checks"), given(profit_to_cfo_ratio=ratio, ar_growth_vs_rev_growth=F.col("ar_growth") - F.col("rev_growth")).alias("metrics"))


def fact_profile(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """A row per document and statement with facts (a single row without a kind
    where a document has none), from one aggregation: what the checks ask for."""
    k, c = F.col("statement_type"), dims.canonical(F.col("concept"))
    first = lambda concept: F.min_by(F.when((c == concept) & F.col("value").isNotNull(), F.col("value")), F.when((c == concept) & F.col("value").isNotNull(), F.col("fact_ord"))).alias(concept)
    of_type = F.when(k == "balance", "instant").otherwise("duration")
    row = F.struct(
        "fact_ord", "fact_id", c.alias("canonical"), "period_start", "period_end", "currency", "scale",
        ((F.col("period_type") != "unknown") & (F.col("period_type") != of_type)).alias("wrong_type"), (F.size("source_refs") > 0).alias("cited"),
    )
    s = facts.groupBy("doc_id", "statement_type").agg(F.array_sort(F.collect_list(row)).alias("facts"), *[first(v) for v in ("total_assets", "total_liabilities", "total_equity", "operating_cash_flow", "capex")])
    return docs.select("doc_id").join(s, "doc_id", "left")


ISSUE = "array<struct<code:string,severity:string,concepts:array<string>,fact_ids:array<string>,detail:string>>"


def fact_issues(p: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, code, severity, statement_type, concepts, fact_ids, detail) of a
    fact profile, for all twelve codes; a document without facts has facts_missing
    alone. Ids come in the order of the facts."""
    k = F.col("statement_type")
    expected = F.lit(None).cast("array<string>")
    for kind, concepts in dims.CRITICAL.items():
        expected = F.when(k == kind, F.array(*map(F.lit, concepts))).otherwise(expected)
    none, nothing = F.lit(None).cast("string"), F.array().cast("array<string>")
    ids = lambda hit: F.transform(F.filter("facts", hit), lambda f: f["fact_id"])
    values = lambda field: F.array_sort(F.array_compact(F.array_distinct(F.transform("facts", lambda f: f[field]))))
    about = lambda *names: ids(lambda f: f["canonical"].isin(*names))
    named_ = lambda *names: F.array(*map(F.lit, names))

    def row(code, severity, concepts=nothing, fact_ids=nothing, detail=none):
        return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), concepts.alias("concepts"), fact_ids.alias("fact_ids"), detail.alias("detail"))

    lost = F.array_except(expected, F.transform("facts", lambda f: f["canonical"]))
    currencies = F.filter(values("currency"), lambda x: x != "")
    whole = F.col("total_assets").isNotNull() & F.col("total_liabilities").isNotNull() & F.col("total_equity").isNotNull()
    off = F.abs(F.col("total_assets") - (F.col("total_liabilities") + F.col("total_equity"))) / F.greatest(F.abs("total_assets"), F.lit(1.0))
    both = F.col("operating_cash_flow").isNotNull() & F.col("capex").isNotNull()
    of_kind, balance, flows = expected.isNotNull(), ("total_assets", "total_liabilities", "total_equity"), ("operating_cash_flow", "capex")
    single = F.array(
        F.when(k.isNull(), row("facts_missing", "high")),
        F.when(of_kind & (F.size(lost) > 0), row("missing_critical_facts", "high", lost, detail=F.array_join(lost, ","))),
        F.when(of_kind & (F.size(values("period_end")) > 1), row("period_inconsistency", "high", fact_ids=ids(lambda f: F.lit(True)))),
        F.when(of_kind & F.exists("facts", lambda f: f["wrong_type"]), row("period_type_inconsistency", "high", fact_ids=ids(lambda f: f["wrong_type"]))),
        F.when(of_kind & (F.size(currencies) > 1), row("currency_inconsistency", "medium", fact_ids=ids(lambda f: f["currency"] != ""), detail=F.array_join(currencies, ","))),
        F.when(of_kind & (F.size(values("scale")) > 1), row("scale_inconsistency", "medium", fact_ids=ids(lambda f: f["scale"].isNotNull()))),
        F.when((k == "balance") & ~whole, row("balance_equation_missing_facts", "high", fact_ids=about(*balance))),
        F.when((k == "balance") & whole & (off >= tolerance), row("balance_equation_failed", "high", named_(*balance), about(*balance))),
        F.when((k == "cashflow") & ~both, row("cashflow_reconciliation_missing_facts", "medium", named_(*flows), about(*flows))),
        F.when((k == "cashflow") & both & (F.col("capex") > 0), row("cashflow_reconciliation_failed", "medium", named_(*flows), about(*flows))),
    )
    key = lambda f: F.struct(f["canonical"], f["period_start"], f["period_end"])
    twins = F.transform(F.array_distinct(F.transform("facts", key)), lambda x: F.struct(x["canonical"].alias("c"), ids(lambda f: key(f).eqNullSafe(x)).alias("ids")))
    twins = F.transform(F.filter(twins, lambda t: F.size(t["ids"]) > 1), lambda t: row("duplicate_concepts", "medium", F.array(t["c"]), t["ids"], t["c"]))
    of = lambda e: F.filter("facts", lambda f: f["canonical"] == e)
    bare = F.filter(expected, lambda e: (F.size(of(e)) > 0) & ~F.exists(of(e), lambda f: f["cited"]))
    bare = F.transform(bare, lambda e: row("missing_source_refs", "high", F.array(e), F.transform(of(e), lambda f: f["fact_id"]), e))
    none_yet = F.array().cast(ISSUE)
    found = F.concat(F.array_compact(single).cast(ISSUE), F.coalesce(twins.cast(ISSUE), none_yet), F.coalesce(bare.cast(ISSUE), none_yet))
    return p.select("doc_id", "statement_type", F.explode(found).alias("i")).select("doc_id", "i.code", "i.severity", "statement_type", "i.concepts", "i.fact_ids", "i.detail")


def validate_facts(docs: DataFrame, facts: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``fact_issues`` with n_facts, the number of ids."""
    return fact_issues(fact_profile(docs, facts), tolerance).withColumn("n_facts", F.size("fact_ids").cast("long"))


def fact_metrics(p: DataFrame) -> DataFrame:
    """(doc_id, fact_count, facts_with_source_refs, facts_present,
    balance_equation_diff_ratio, free_cash_flow) of a fact profile, all documents."""
    n = F.coalesce(F.size("facts"), F.lit(0)).cast("long")
    cited = F.coalesce(F.size(F.filter("facts", lambda f: f["cited"])), F.lit(0)).cast("long")
    off = F.abs(F.col("total_assets") - (F.col("total_liabilities") + F.col("total_equity"))) / F.greatest(F.abs("total_assets"), F.lit(1.0))
    return p.groupBy("doc_id").agg(
        F.sum(n).alias("fact_count"), F.sum(cited).alias("facts_with_source_refs"), F.bool_or(F.col("facts").isNotNull()).alias("facts_present"),
        F.max(F.when(F.col("statement_type") == "balance", off)).alias("balance_equation_diff_ratio"),
        F.max(F.when(F.col("statement_type") == "cashflow", F.col("operating_cash_flow") + F.col("capex"))).alias("free_cash_flow"),
    )


# Checks of facts and the issues that fail them, in order.
CHECKS = {
    "facts_present": ("facts_missing",), "missing_critical_facts": ("missing_critical_facts",), "duplicate_concepts": ("duplicate_concepts",),
    "period_consistency": ("period_inconsistency", "period_type_inconsistency"), "scale_currency_consistency": ("currency_inconsistency", "scale_inconsistency"),
    "critical_facts_have_source_refs": ("missing_source_refs",), "balance_equation": ("balance_equation_missing_facts", "balance_equation_failed"),
    "cashflow_reconciliation": ("cashflow_reconciliation_missing_facts", "cashflow_reconciliation_failed"),
}


def fact_checks(p: DataFrame) -> DataFrame:
    """(doc_id, check, passed): equation and reconciliation only of documents that
    have the statement; without facts only facts_present."""
    failed = fact_issues(p).groupBy("doc_id").agg(F.collect_set("code").alias("codes"))
    held = p.groupBy("doc_id").agg(F.collect_set("statement_type").alias("kinds"))
    j = held.join(failed, "doc_id", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    needs = {"balance_equation": "balance", "cashflow_reconciliation": "cashflow"}
    rows = []
    for check, codes in CHECKS.items():
        applies = F.array_contains("kinds", needs[check]) if check in needs else (F.size("kinds") > 0) | F.lit(check == "facts_present")
        rows.append(F.when(applies, F.struct(F.lit(check).alias("check"), (~F.arrays_overlap("codes", F.array(*map(F.lit, codes)))).alias("passed"))))
    return j.select("doc_id", F.explode(F.array_compact(F.array(*rows))).alias("c")).select("doc_id", "c.*")


def is_severe(issue: Column) -> Column:
    return issue.isin("balance_equation_failed", "balance_missing_totals") | issue.startswith("unit_mismatch")


def gate(docs: DataFrame, statement_issues: DataFrame, fact_issues: DataFrame) -> DataFrame:
    """(doc_id, severe): whether a document goes to review."""
    severe = statement_issues.where(is_severe(F.col("issue"))).select("doc_id")
    severe = severe.unionByName(fact_issues.where("severity = 'high'").select("doc_id")).distinct().withColumn("_s", F.lit(True))
    return docs.select("doc_id").join(severe, "doc_id", "left").select("doc_id", F.coalesce("_s", F.lit(False)).alias("severe"))
