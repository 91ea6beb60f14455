"""Core metrics per document, and the export envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingspark import dims
from filingspark.functions import dates, text


def core_metrics(items: DataFrame) -> DataFrame:
    """(doc_id, metric, value, confidence, source_page) from line items: one
    aggregation on doc_id picks the first line item of each alias group, arithmetic
    and an unpivot do the rest; zero denominators leave a metric out."""

    def of(kind: str) -> Column:
        aliases = dims.METRIC_ALIASES[kind]
        labelled = text.label_key(F.col("name_norm")).isin(*aliases) | text.label_key(F.col("name_raw")).isin(*aliases)
        hit = (F.col("statement_type") == dims.METRIC_STATEMENT[kind]) & F.col("value_current").isNotNull() & labelled
        ref = F.get("source_refs", F.lit(0))
        row = F.struct("value_current", "value_prior", ref["page"].alias("page"), F.coalesce(ref["confidence"], F.col("confidence")).alias("confidence"))
        return F.min_by(F.when(hit, row), F.when(hit, F.col("item_ord"))).alias(kind)

    w = items.groupBy("doc_id").agg(*[of(kind) for kind in dims.METRIC_ALIASES])
    now, was = (lambda x: F.col(f"{x}.value_current")), (lambda x: F.col(f"{x}.value_prior"))
    rate = lambda x: F.when(was(x) != 0, F.bround((now(x) - was(x)) / F.abs(was(x)), 6))
    gross = F.coalesce(now("gross_profit"), now("revenue") - now("cogs"))

    def entry(name: str, value: Column, of: str) -> Column:
        return F.struct(F.lit(name).alias("metric"), value.alias("value"), F.col(f"{of}.confidence").alias("confidence"), F.col(f"{of}.page").alias("source_page"))

    entries = F.array(
        entry("revenue_growth", rate("revenue"), "revenue"),
        entry("net_profit_growth", rate("net_profit"), "net_profit"),
        entry("gross_margin", F.when(now("revenue") != 0, F.bround(gross / now("revenue"), 6)), "revenue"),
        entry("operating_cash_flow", F.bround(now("operating_cash"), 2), "operating_cash"),
        entry("debt_ratio", F.when(now("total_assets") != 0, F.bround(now("total_liabilities") / now("total_assets"), 6)), "total_liabilities"),
    )
    return w.select("doc_id", F.explode(F.filter(entries, lambda e: e["value"].isNotNull())).alias("e")).select("doc_id", "e.*")


def valid_metric(name: Column) -> Column:
    """Trimmed, lower-case metric name; null where it is empty."""
    return F.nullif(F.lower(F.trim(name)), F.lit(""))


def dedupe_metrics(exported: DataFrame) -> DataFrame:
    """One row per (doc_id, metric): the strictly more confident one, else the
    first; it takes the place of the first. Needs metric_ord and confidence."""
    rest = [c for c in exported.columns if c not in ("doc_id", "metric", "metric_ord")]
    best = F.max_by(F.struct(*rest), F.struct("confidence", -F.col("metric_ord"))).alias("b")
    return exported.groupBy("doc_id", "metric").agg(best, F.min("metric_ord").alias("metric_ord")).select("doc_id", "metric", "metric_ord", "b.*")


def envelopes(meta: DataFrame, metrics: DataFrame, signals: DataFrame) -> DataFrame:
    """(doc_id, period, export): a JSON envelope per document."""
    m = metrics.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("metric", "value", "confidence", "source_page"))).alias("facts"))
    s = signals.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("category", "title", "severity", "description"))).alias("risk_signals"))
    period = dates.period_label(F.col("period_end"), F.col("filing_type"))
    all_ = meta.join(m, "doc_id", "left").join(s, "doc_id", "left").withColumn("period", period)
    body = F.to_json(F.struct(F.col("doc_id").alias("symbol"), "period", F.coalesce("facts", F.array()).alias("facts"), F.coalesce("risk_signals", F.array()).alias("risk_signals")))
    return all_.select("doc_id", "period", body.alias("export"))
