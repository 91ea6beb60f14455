"""Fixed dimensions: account names, labels and critical facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Account names as filings print them, to concepts.
ACCOUNTS = {
    "net sales": "revenue", "total net sales": "revenue", "revenue": "revenue", "sales": "revenue",
    "total cost of sales": "cost_of_goods_sold", "cost of sales": "cost_of_goods_sold",
    "gross margin": "gross_profit", "gross profit": "gross_profit",
    "operating profit": "operating_income", "operating income": "operating_income", "net income": "net_income",
    "cash and equivalents": "cash_and_equivalents", "cash and cash equivalents": "cash_and_equivalents",
    "total assets": "total_assets", "total liabilities": "total_liabilities",
    "total shareholders’ equity": "total_equity", "total shareholders' equity": "total_equity",
    "cash generated by operating activities": "operating_cf", "net cash provided by operating activities": "operating_cf",
    "cash flow from operations": "operating_cf", "net cash from operating activities": "operating_cf",
    "capital expenditures": "capex", "purchase of property and equipment": "capex",
    "营业收入": "revenue", "主营业务收入": "revenue", "收入": "revenue", "营业成本": "cost_of_goods_sold",
    "毛利": "gross_profit", "毛利润": "gross_profit", "营业利润": "operating_income", "净利润": "net_income",
    "归属于母公司所有者的净利润": "net_income", "货币资金": "cash_and_equivalents", "资产总计": "total_assets",
    "负债合计": "total_liabilities", "所有者权益合计": "total_equity", "经营活动产生的现金流量净额": "operating_cf",
    "购建固定资产、无形资产和其他长期资产支付的现金": "capex",
}
# Concepts that a statement's totals hold.
TOTAL_CONCEPTS = ("total_assets", "total_liabilities", "total_equity", "cash_and_equivalents", "revenue", "gross_profit", "operating_income", "net_income", "operating_cf", "capex")
CRITICAL = {
    "income": ("revenue", "gross_profit", "net_income"),
    "balance": ("total_assets", "total_liabilities", "total_equity"),
    "cashflow": ("operating_cash_flow", "capex"),
}
# Labels that core metrics accept.
METRIC_ALIASES = {
    "revenue": ("revenue", "total_revenue", "net_revenue", "sales", "营业收入", "营业总收入", "营业收入_净额"),
    "cogs": ("cost_of_revenue", "cost_of_goods_sold", "cogs", "cost_of_sales", "营业成本", "营业总成本"),
    "gross_profit": ("gross_profit", "gross_margin_amount", "毛利润", "毛利"),
    "net_profit": ("net_income", "net_profit", "profit_for_the_period", "净利润", "归属于母公司所有者的净利润", "归母净利润"),
    "operating_cash": ("net_cash_from_operating_activities", "cash_flow_from_operations", "operating_cash_flow", "经营活动产生的现金流量净额", "经营活动现金流量净额"),
    "total_assets": ("total_assets", "资产总计", "资产总额"),
    "total_liabilities": ("total_liabilities", "负债合计", "负债总额"),
}
# The statement that each metric is read from.
METRIC_STATEMENT = {"revenue": "income", "cogs": "income", "gross_profit": "income", "net_profit": "income", "operating_cash": "cashflow", "total_assets": "balance", "total_liabilities": "balance"}
# The facts that critical accuracy reports on.
KEY_FACTS = ("revenue", "gross_profit", "operating_income", "net_income", "total_assets", "total_liabilities", "total_equity", "cash_and_equivalents", "operating_cash_flow", "capex")
# Fields of a fact that may be corrected.
CORRECTABLE = ("concept", "label", "raw_label", "value", "unit", "scale", "currency", "period_start", "period_end", "period_type", "source_refs")


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def accounts(df: DataFrame) -> DataFrame:
    """The account dictionary as a table of fixed size."""
    return df.sparkSession.createDataFrame(list(ACCOUNTS.items()), "account string, concept string")


def canonical(concept: Column) -> Column:
    return F.when(concept == "operating_cf", "operating_cash_flow").otherwise(concept)
