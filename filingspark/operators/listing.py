"""Listings, task status, run metrics and other small reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingspark.functions import numbers as printing
from filingspark.functions import text

# Progress of the stages of an analysis, and histogram bounds.
PROGRESS = {"ingest_pdf": 15, "extract_tables": 25, "detect_sections_and_chunk": 35, "extract_financial_statements": 50, "validate_and_reconcile": 60, "extract_key_notes": 70, "generate_risk_signals": 80, "build_trader_report": 90, "finalize": 100}
NODE_BUCKETS = (0.5, 1.0, 5.0, 10.0, 30.0, 60.0)
RUN_BUCKETS = (1.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0)
PAGE_BUCKETS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 200.0)
#: Headlines of a filing and the names that they go by.
HEADLINES = {"revenue": "(?i)revenue|net sales|营业收入", "net_income": "(?i)net income|net profit|净利润", "assets": "(?i)total assets|资产总计", "operating_cash": "(?i)operating activities|operating cash|经营活动"}


def documents(meta: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the listing, newest first; limit 1 to 200, with the total."""
    limit, offset = max(1, min(limit, 200)), max(0, offset)
    total = meta.agg(F.count("*").alias("n")).scalar()
    return meta.orderBy(F.desc("created_at"), "doc_id").offset(offset).limit(limit).withColumn("total", total)


def preferred_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of two stores by doc_id; the first store's where both have one."""
    both = first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(1)))
    w = Window.partitionBy("doc_id").orderBy("_p")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_p")


def progress(node: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in PROGRESS.items() for x in kv])
    return F.coalesce(F.element_at(m, node), F.lit(0))


def task_status(events: DataFrame) -> DataFrame:
    """(doc_id, status, progress, current_node, error_message): the last value of
    each field that was given; queued and 0 where none was."""
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct("ts", "event_ord"))).alias(c)
    s = events.groupBy("doc_id").agg(*[last(c) for c in ("status", "progress", "current_node", "error_message")])
    return s.select("doc_id", F.coalesce("status", F.lit("queued")).alias("status"), F.coalesce("progress", F.lit(0)).alias("progress"), "current_node", "error_message")


def documents_with_status(meta: DataFrame, status: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the listing with each document's task, null where it has none."""
    task = status.select("doc_id", F.struct("status", "progress", "current_node", "error_message").alias("task"))
    return documents(meta, limit, offset).join(task, "doc_id", "left")


def histogram(rows: DataFrame, value: str, buckets, *by: str) -> DataFrame:
    """(by.., le, n): cumulative counts up to each bound, one pass over the rows."""
    w = rows.groupBy(*by).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(buckets)], F.count(value).alias("all"))
    entries = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(buckets)]
    return w.select(*by, F.explode(F.array(*entries, F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n")))).alias("h")).select(*by, "h.*")


def admitted_by_window(events: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """Audit of admissions over all events: (key, start, n, over) per window."""
    w = events.groupBy("key", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    return w.select("key", F.col("w.start").alias("start"), "n", (F.col("n") > limit).alias("over"))


def headline(metrics: DataFrame) -> DataFrame:
    """(doc_id, headline, name, value): the first metric of each headline, all in
    one aggregation."""
    first = lambda p: F.min_by(F.struct("name", "value"), F.when(F.col("name").rlike(p), F.col("ord")))
    w = metrics.groupBy("doc_id").agg(*[first(p).alias(h) for h, p in HEADLINES.items()])
    rows = F.array(*[F.struct(F.lit(h).alias("headline"), F.col(h).alias("m")) for h in HEADLINES])
    return w.select("doc_id", F.explode(rows).alias("r")).where("r.m is not null").select("doc_id", "r.headline", "r.m.name", "r.m.value")


def metric_rows(items: DataFrame, totals: DataFrame) -> DataFrame:
    """Line items and totals as flat metric rows with a display name."""
    i = items.select("doc_id", "statement_type", F.coalesce(F.nullif("name_norm", F.lit("")), "name_raw").alias("name"), F.col("value_current").alias("value"), F.coalesce(F.get("source_refs", F.lit(0))["confidence"], "confidence").alias("confidence"), F.lit("item").alias("origin"))
    t = totals.select("doc_id", "statement_type", F.col("concept").alias("name"), "value", F.lit(None).cast("double").alias("confidence"), F.lit("total").alias("origin"))
    return i.unionByName(t)


def metric_strings(metrics: Column) -> Column:
    """A map's entries as 'k: v', blanks left out."""
    kept = F.filter(F.map_entries(metrics), lambda e: F.coalesce(F.trim(e["value"]), F.lit("")) != "")
    return F.transform(kept, lambda e: F.concat_ws(": ", e["key"], e["value"]))


def limitations(*lists: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])))


def evidence_on_page(items: DataFrame, page: int) -> DataFrame:
    """Evidence that a page holds, for highlights; entries without a page drop."""
    refs = F.filter("source_refs", lambda r: r["page"].isNotNull())
    return items.select("doc_id", "item_ord", F.explode(refs).alias("ref")).where(F.col("ref.page") == page)


def enriched_meta(meta: DataFrame, pages: DataFrame) -> DataFrame:
    """Document metadata with company, report type and period end inferred from
    the first three pages where they are missing."""
    from filingspark.functions import dates

    t = pages.where("page_number <= 3").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda x: x["text"]), "\n").alias("t"))
    j = meta.join(t, "doc_id", "left").withColumn("t", F.coalesce("t", F.lit("")))
    return j.select("doc_id", "filename", F.coalesce("company", text.company(F.col("t"), F.col("filename"))).alias("company"), F.coalesce("report_type", text.report_type(F.col("t"), F.col("filename"))).alias("report_type"), F.coalesce("period_end", dates.period_end(F.col("t"), F.col("filename"))).alias("period_end"))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` that differ from the row of the same doc_id, or are new."""
    rest = [c for c in new.columns if c != "doc_id"]
    o = old.select("doc_id", F.struct(*rest).alias("_o"))
    return new.join(o, "doc_id", "left").where(F.col("_o").isNull() | ~F.struct(*rest).eqNullSafe(F.col("_o"))).drop("_o")


def markdown_report(meta: DataFrame, metrics: DataFrame, signals: DataFrame) -> DataFrame:
    """(doc_id, report): Markdown with a fixed order of sections."""
    m = metrics.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("- "), "metric", F.lit(": "), printing.printed(F.col("value"), 6)))).alias("m"))
    s = signals.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("- ["), "severity", F.lit("] "), "title"))).alias("s"))
    j = meta.join(m, "doc_id", "left").join(s, "doc_id", "left")
    block = lambda c: F.coalesce(F.array_join(c, "\n"), F.lit("None."))
    return j.select("doc_id", F.concat_ws("\n\n", F.concat(F.lit("# Report "), "doc_id"), F.lit("## Core metrics"), block("m"), F.lit("## Risk signals"), block("s")).alias("report"))


# What a report says where nothing else is given.
DRIVERS = ("See extracted statements and notes.",)
LIMITS = ("Not financial advice.", "Outputs depend on PDF extraction quality.")


def numbers_snapshot(totals: DataFrame) -> DataFrame:
    """(doc_id, numbers): a document's totals (statement_type, concept, value) as an array of (concept, value) by
    concept; of several statements with a concept the last in the order income, balance, cashflow wins."""
    order = F.array_position(F.array(*map(F.lit, ("income", "balance", "cashflow"))), F.col("statement_type"))
    last = totals.groupBy("doc_id", "concept").agg(F.max_by("value", order).alias("value"))
    return last.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("concept", "value"))).alias("numbers"))


def _evidence(refs: Column) -> Column:
    """A line for every piece of evidence."""
    line = lambda r: F.concat(F.lit("  - Evidence: page "), F.coalesce(r["page"].cast("string"), F.lit("None")), F.lit(" ("), F.coalesce(r["ref_type"], F.lit("None")), F.lit(") "), F.coalesce(r["quote"], F.lit("")))
    return F.transform(F.coalesce(refs, F.array().cast("array<struct<page:int,ref_type:string,quote:string>>")), line)


def _ref_rows(column: str) -> Column:
    """Evidence as (page, ref_type, quote), whatever else it holds."""
    return F.transform(column, lambda r: F.struct(r["page"].cast("int").alias("page"), r["ref_type"].alias("ref_type"), r["quote"].alias("quote")))


def full_report(meta: DataFrame, numbers: DataFrame, signals: DataFrame, notes: DataFrame, drafts: DataFrame | None = None, findings: DataFrame | None = None) -> DataFrame:
    """(doc_id, report): the whole Markdown report in its fixed order of sections.

    ``meta`` is (doc_id, filename, n_pages, created_at text), ``numbers`` that of ``numbers_snapshot``, ``signals``
    (doc_id, sig_ord, title, severity, description, evidence), ``notes`` (doc_id, note_ord, note_type, summary,
    source_refs). ``drafts`` (doc_id, executive_summary, key_drivers, limitations, deep_summary, deep_limitations) gives
    what was written about a document; blank or empty fields, and documents without a draft, get the plain ones.
    ``findings`` (doc_id, sig_ord, title, severity, description, evidence) stand under the deep summary; the section is
    there where a deep summary is not null. Values are printed with two places. Empty sections keep their heads; null texts are printed as nothing."""
    none = F.array().cast("array<string>")
    block = lambda head, ref: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", head.alias("head"), ref.alias("refs")))), lambda x: F.concat(F.array(x["head"]), _evidence(x["refs"]))))
    plain = lambda c: F.coalesce(c, F.lit(""))
    said = F.concat(F.lit("- "), plain("title"), F.lit(" ("), plain("severity"), F.lit("): "), plain("description"))
    s = signals.withColumn("ord", F.col("sig_ord")).groupBy("doc_id").agg(block(said, _ref_rows("evidence")).alias("s"))
    n = notes.withColumn("ord", F.col("note_ord")).groupBy("doc_id").agg(block(F.concat(F.lit("- "), plain("note_type"), F.lit(": "), plain("summary")), _ref_rows("source_refs")).alias("n"))
    j = meta.select("doc_id", plain("filename").alias("filename"), "n_pages", "created_at").join(numbers, "doc_id", "left").join(s, "doc_id", "left").join(n, "doc_id", "left")
    if findings is not None:
        j = j.join(findings.withColumn("ord", F.col("sig_ord")).groupBy("doc_id").agg(block(said, _ref_rows("evidence")).alias("f")), "doc_id", "left")
    else:
        j = j.withColumn("f", none)
    if drafts is not None:
        j = j.join(drafts.select("doc_id", "executive_summary", "key_drivers", "limitations", "deep_summary", "deep_limitations"), "doc_id", "left")
    else:
        j = j.withColumns({c: F.lit(None).cast("string") for c in ("executive_summary", "deep_summary")} | {c: none for c in ("key_drivers", "limitations", "deep_limitations")})
    summary = F.coalesce(F.nullif("executive_summary", F.lit("")), F.concat(F.lit("Parsed "), F.coalesce("n_pages", F.lit(0)).cast("string"), F.lit(" pages for "), "filename", F.lit(".")))
    drivers = F.when(F.size(F.coalesce("key_drivers", none)) > 0, F.col("key_drivers")).otherwise(F.array(*map(F.lit, DRIVERS)))
    bullets = lambda c: F.transform(c, lambda x: F.concat(F.lit("- "), x))
    shown = F.transform("numbers", lambda x: F.concat(F.lit("- "), x["concept"], F.lit(": "), printing.printed(x["value"], 2)))
    head = lambda title: F.array(F.lit(""), F.lit(f"## {title}"))
    deep = F.when(F.col("deep_summary").isNotNull(), F.concat(head("Deep Analysis"), F.array("deep_summary"), F.coalesce("f", none))).otherwise(none)
    lines = F.concat(
        F.array(F.concat(F.lit("# Trader Report for "), "filename")), head("Executive Summary"), F.array(summary), head("Key Drivers"), bullets(drivers), head("Numbers Snapshot"), F.coalesce(shown, none),
        head("Risk Signals"), F.coalesce("s", none), deep, head("Notes"), F.coalesce("n", none), head("Limitations"), bullets(limitations(F.array(*map(F.lit, LIMITS)), F.col("limitations"), F.col("deep_limitations"))),
        F.array(F.concat(F.lit("\nGenerated at "), F.coalesce("created_at", F.lit("")), F.lit("."))),
    )
    return j.select("doc_id", F.array_join(lines, "\n").alias("report"))
