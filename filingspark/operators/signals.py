"""Risk signals: four rules with their evidence, and the merge of signals that say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingspark.functions import text
from filingspark.operators.facts import fallback_refs
from filingspark.operators.validate import is_severe

GROWTH_GAP = 0.2
SEVERITIES = ("low", "medium", "high")


def rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def signal_id(doc_id: Column, category: Column, title: Column) -> Column:
    return F.concat(F.lit("sig_"), F.left(F.sha1(F.concat_ws("|", doc_id, category, title)), F.lit(16)))


def _signal(category: str, title: str, severity, description, metrics: Column, evidence: Column) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        F.lit(category).alias("category"), F.lit(title).alias("title"), as_column(severity).alias("severity"),
        as_column(description).alias("description"), metrics.alias("metrics"), evidence.alias("evidence"),
    )


def _as_text(**values: Column) -> Column:
    """A map of the values that are there, as text."""
    entries = [F.when(c.isNotNull(), F.struct(F.lit(k), c.cast("string"))) for k, c in values.items()]
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def signals(profile: DataFrame, pages: DataFrame | None = None, notes: DataFrame | None = None) -> DataFrame:
    """(doc_id, category, title, severity, description, metrics map, evidence,
    signal_id) of a profile of line items. Evidence is the statement's first, else
    the first page's first line, where pages are given, else a remark."""
    first = F.lit(None).cast("string")
    if pages is not None:
        text_of = pages.where("page_number = 1").select("doc_id", F.col("text").alias("_first"))
        profile, first = profile.join(text_of, "doc_id", "left"), F.col("_first")
    fallback = fallback_refs(first)
    ni, cf = F.col("net_income"), F.col("operating_cf")
    severe = F.exists("issues", is_severe)
    found = F.array(
        F.when((ni > 0) & (cf < 0), _signal(
            "cash_vs_profit", "Positive profit with negative operating cashflow", F.when(F.abs(cf) > F.abs(ni), "high").otherwise("medium"),
            "Net income is positive while operating cashflow is negative.", _as_text(net_income=ni, operating_cf=cf), F.coalesce("cashflow_refs", fallback))),
        F.when(F.col("ar_growth") - F.col("rev_growth") > GROWTH_GAP, _signal(
            "working_capital", "Receivables growth outpaces revenue", "medium", "Accounts receivable growth exceeds revenue growth.",
            _as_text(ar_growth=F.col("ar_growth"), rev_growth=F.col("rev_growth"), inventory_growth=F.col("inventory_growth")), F.coalesce("balance_refs", fallback))),
        F.when(severe, _signal(
            "disclosure_inconsistency", "Statement reconciliation issues", "high", "Balance equation or unit consistency checks failed.",
            _as_text(issues=F.array_join(F.array_sort("issues"), ",")), fallback)),
    )
    out = profile.select("doc_id", F.explode(F.array_compact(found)).alias("s")).select("doc_id", "s.*")
    if pages is not None:
        out = out.unionByName(audit(pages, notes))
    return out.withColumn("signal_id", signal_id(F.col("doc_id"), F.col("category"), F.col("title")))


def audit(pages: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """The first audit word, in the list's order, in notes and first two pages."""
    said = pages.where("page_number <= 2").select("doc_id", F.col("text").alias("t"), F.when(F.col("page_number") == 1, F.col("text")).alias("p"))
    if notes is not None:
        said = said.unionByName(notes.select("doc_id", F.col("summary").alias("t"), F.lit(None).cast("string").alias("p")))
    order = F.array(*map(F.lit, text.AUDIT_WORDS))
    held = F.array_min(F.transform(F.filter(order, lambda w: F.contains(F.col("t"), w)), lambda w: F.array_position(order, w)))
    w = said.groupBy("doc_id").agg(F.min(held).alias("at"), F.max("p").alias("p")).where("at is not null")
    w = w.withColumn("w", F.element_at(order, F.col("at").cast("int")))
    severity = F.when(F.col("w").isin(*text.AUDIT_MEDIUM), "medium").otherwise("high")
    row = _signal("audit_governance", "Audit opinion flags", severity, F.format_string("Audit opinion contains keyword: %s.", "w"), _as_text(keyword=F.col("w")), fallback_refs(F.col("p")))
    return w.select("doc_id", row.alias("s")).select("doc_id", "s.*")


def merged_evidence(lists: Column) -> Column:
    """The distinct pieces of evidence of lists of them, first come first."""
    key = lambda r: F.struct(r["ref_type"], r["page"], r["table_id"], r["quote"])
    every = F.flatten(lists)
    seen = F.transform(every, key)
    return F.filter(every, lambda r, i: F.array_position(F.transform(seen, lambda k: F.to_json(k)), F.to_json(key(r))) == i + 1)


def merge_signals(found: DataFrame) -> DataFrame:
    """One signal per (doc_id, category, trimmed title): the first one's id, the
    greatest severity, the longest description (the first of equals), metrics
    where later ones win, all distinct evidence. Needs sig_ord and signal_id."""
    key = ["doc_id", "category", "title"]
    s = found.withColumn("title", F.trim("title"))
    cited = [merged_evidence(F.transform(F.array_sort(F.collect_list(F.struct("sig_ord", "evidence"))), lambda x: x["evidence"])).alias("evidence")] if "evidence" in found.columns else []
    entries = lambda m: F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>")))
    later = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sig_ord", entries(F.col("metrics")).alias("m")))), lambda x: x["m"]))
    merged = s.groupBy(*key).agg(
        F.min_by("signal_id", "sig_ord").alias("signal_id"),
        F.max(rank(F.col("severity"))).alias("r"),
        F.max_by("description", F.struct(F.length("description"), -F.col("sig_ord"))).alias("description"),
        F.min("sig_ord").alias("first_ord"), later.alias("all"), *cited,
    )
    names = F.array_sort(F.array_distinct(F.transform("all", lambda e: e["key"])))
    value = lambda k: F.element_at(F.filter("all", lambda e: e["key"] == k), -1)["value"]
    metrics = F.map_from_entries(F.transform(names, lambda k: F.struct(k, value(k)))).alias("metrics")
    severity = F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("r").cast("int")).alias("severity")
    return merged.select(*key, "signal_id", severity, "description", metrics, F.col("first_ord").alias("sig_ord"), *(["evidence"] if cited else []))


def dedupe_notes(notes: DataFrame) -> DataFrame:
    """The first note of each (doc_id, type, trimmed summary)."""
    w = Window.partitionBy("doc_id", "note_type", F.trim("summary")).orderBy("note_ord")
    return notes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def assembled_notes(docs: DataFrame, notes: DataFrame) -> DataFrame:
    """Deduplicated notes, and a placeholder for documents without any."""
    kept = dedupe_notes(notes)
    none = docs.select("doc_id").join(kept.select("doc_id"), "doc_id", "left_anti")
    return kept.unionByName(none.select("doc_id", F.lit(0).alias("note_ord"), F.lit("other").alias("note_type"), F.lit("No key notes extracted.").alias("summary")), allowMissingColumns=True)


def dedupe_evidence(items: DataFrame, keep: int = 6) -> DataFrame:
    """The first ``keep`` distinct pieces of evidence of each document, in order
    of items and of their place in the item."""
    e = items.select("doc_id", "item_ord", F.posexplode("source_refs").alias("ref_ord", "ref"))
    key = ["doc_id", "ref.ref_type", "ref.page", "ref.table_id", "ref.quote"]
    first = e.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("item_ord", "ref_ord"))).where("_n = 1")
    return first.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("item_ord", "ref_ord"))).where(F.col("_n") <= keep).drop("_n")


def top(signals: DataFrame, n: int = 5) -> DataFrame:
    """A document's ``n`` severest signals, in their own order (sig_ord) where equal."""
    order = Window.partitionBy("doc_id").orderBy(F.coalesce(rank(F.col("severity")), F.lit(0)).desc(), "sig_ord")
    return signals.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def severity_summary(signals: DataFrame) -> DataFrame:
    """(doc_id, high, medium, low, other): a document's signals by severity."""
    kinds = ("high", "medium", "low")
    counts = [F.count_if(F.col("severity") == k).alias(k) for k in kinds]
    return signals.groupBy("doc_id").agg(*counts, F.count_if(~F.coalesce(F.col("severity").isin(*kinds), F.lit(False))).alias("other"))
