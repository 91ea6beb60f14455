"""Scores against labelled cases, and the threshold gate.

Cases are doc_ids; expected facts are (doc_id, key, value) with ``concept`` or
``statement_type:concept`` keys. Empty inputs score as their docstrings say.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingspark import dims

TOLERANCE = 0.05


def _aliases(concept):
    cash = concept.isin("operating_cf", "operating_cash_flow")
    return F.when(cash, F.array(F.lit("operating_cash_flow"), F.lit("operating_cf"))).otherwise(F.array(concept))


def fact_matches(facts: DataFrame, expected: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Expected rows with ``actual`` and ``outcome`` (matched, mismatched, missing).
    A bare concept means the first fact of it, a qualified one the last."""
    keys = F.flatten(F.transform(_aliases(F.col("concept")), lambda c: F.array(c, F.concat_ws(":", "statement_type", c))))
    f = facts.select("doc_id", "value", "fact_ord", F.explode(keys).alias("key")).groupBy("doc_id", "key")
    known = f.agg(F.when(F.col("key").contains(":"), F.max_by(F.struct("value"), "fact_ord")).otherwise(F.min_by(F.struct("value"), "fact_ord")).alias("v"))
    j = expected.join(known, ["doc_id", "key"], "left").withColumn("actual", F.col("v.value")).drop("v")
    off = F.abs(F.col("actual") - F.col("value")) / F.greatest(F.abs("value"), F.lit(1e-6))
    return j.withColumn("outcome", F.when(F.col("actual").isNull(), "missing").when(off <= tolerance, "matched").otherwise("mismatched"))


def fact_accuracy(matches: DataFrame) -> DataFrame:
    """(doc_id, n_expected, n_matched, accuracy)."""
    m = F.count_if(F.col("outcome") == "matched")
    return matches.groupBy("doc_id").agg(F.count("*").alias("n_expected"), m.alias("n_matched"), (m / F.count("*")).alias("accuracy"))


def statement_accuracy(items: DataFrame, totals: DataFrame, expected: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, statement_type, accuracy) against expected totals (doc_id,
    statement_type, concept, value): a total, else the first line item."""
    t = totals.select("doc_id", "statement_type", "concept", F.col("value").alias("actual"), F.lit(-1).alias("ord"))
    i = items.where("value_current is not null").select("doc_id", "statement_type", F.col("name_norm").alias("concept"), F.col("value_current").alias("actual"), F.col("item_ord").alias("ord"))
    known = t.unionByName(i).withColumn("alias", F.explode(_aliases(F.col("concept"))))
    first = known.groupBy("doc_id", "statement_type", F.col("alias").alias("concept")).agg(F.min_by("actual", F.struct(F.col("ord"), F.col("alias") != F.col("concept"))).alias("actual"))
    j = expected.join(first, ["doc_id", "statement_type", "concept"], "left")
    hit = F.coalesce(F.abs(F.col("actual") - F.col("value")) / F.greatest(F.abs("value"), F.lit(1e-6)) <= tolerance, F.lit(False))
    return j.groupBy("doc_id", "statement_type").agg(F.avg(hit.cast("int")).alias("accuracy"))


def balance_pass_rate(items: DataFrame, totals: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """One row: documents with a balance statement that holds; missing totals
    fail, zero totals count as missing, none checked is 1."""
    b = totals.where("statement_type = 'balance'").select("doc_id", "concept", "value", F.lit(-1).alias("ord"))
    i = items.where("statement_type = 'balance' and value_current is not null").select("doc_id", F.col("name_norm").alias("concept"), F.col("value_current").alias("value"), F.col("item_ord").alias("ord"))
    docs = items.where("statement_type = 'balance'").select("doc_id").distinct()

    def pick(c):
        is_ = (F.col("concept") == c) & (F.col("value") != 0)
        return F.min_by(F.when(is_, F.col("value")), F.when(is_, F.col("ord"))).alias(c)

    w = docs.join(b.unionByName(i).groupBy("doc_id").agg(*[pick(c) for c in ("total_assets", "total_liabilities", "total_equity")]), "doc_id", "left")
    off = F.abs(F.col("total_assets") - (F.col("total_liabilities") + F.col("total_equity"))) / F.greatest(F.abs("total_assets"), F.lit(1e-6))
    return w.agg(F.lit("balance_equation_pass_rate").alias("metric"), F.coalesce(F.avg(F.coalesce(off <= tolerance, F.lit(False)).cast("int")), F.lit(1.0)).alias("value"))


def cited_share(*tables: DataFrame) -> DataFrame:
    """(doc_id, completeness) of rows with evidence (source_refs) over tables."""
    rows = reduce(DataFrame.unionByName, [t.select("doc_id", "source_refs") for t in tables])
    return rows.groupBy("doc_id").agg(F.avg((F.size("source_refs") > 0).cast("int")).alias("completeness"))


def recall(actual: DataFrame, expected: DataFrame, column: str) -> DataFrame:
    """(doc_id, recall) of the expected values of a column; none expected is 1."""
    hits = expected.select("doc_id", column).distinct().join(actual.select("doc_id", column).distinct().withColumn("_hit", F.lit(1)), ["doc_id", column], "left")
    return hits.groupBy("doc_id").agg(F.coalesce(F.avg(F.when(F.col(column).isNotNull(), F.coalesce("_hit", F.lit(0)))), F.lit(1.0)).alias("recall"))


def key_fact_accuracy(matches: DataFrame) -> DataFrame:
    """(metric, value): accuracy of each key fact that is expected anywhere."""
    concept = dims.canonical(F.substring_index("key", ":", -1))
    m = matches.withColumn("concept", concept).where(F.col("concept").isin(*dims.KEY_FACTS))
    return m.groupBy(F.concat(F.lit("fact_accuracy_"), "concept").alias("metric")).agg(F.avg((F.col("outcome") == "matched").cast("int")).alias("value"))


def average(per_case: DataFrame, column: str, metric: str) -> DataFrame:
    """One row: a metric's mean over cases, 0 without any."""
    return per_case.agg(F.lit(metric).alias("metric"), F.coalesce(F.avg(column), F.lit(0.0)).alias("value"))


def case_summaries(cases: DataFrame, facts: DataFrame, matches: DataFrame, signals: DataFrame, notes: DataFrame, expected_signals: DataFrame, expected_notes: DataFrame) -> DataFrame:
    """A row per case (doc_id): counts, fact_value_accuracy (null where none is
    expected), completeness of evidence and recalls, 1 where there is nothing.
    Every table meets the cases as one row of a case."""
    kinds = lambda t, c, n: t.groupBy("doc_id").agg(F.collect_set(c).alias(n))
    cited = lambda c: F.count_if(F.size(c) > 0)
    f = facts.groupBy("doc_id").agg(F.count("*").alias("fact_count"), (cited("source_refs") / F.count("*")).alias("fact_cited"))
    m = fact_accuracy(matches).select("doc_id", F.col("n_expected").alias("expected_fact_count"), F.col("accuracy").alias("fact_value_accuracy"))
    s = signals.groupBy("doc_id").agg(F.count("*").alias("risk_signal_count"), cited("evidence").alias("s_cited"), F.collect_set("category").alias("categories"))
    n = notes.groupBy("doc_id").agg(F.count("*").alias("note_count"), cited("source_refs").alias("n_cited"), F.collect_set("note_type").alias("types"))
    j = cases.select("doc_id").distinct()
    for t in (f, m, s, n, kinds(expected_signals, "category", "want_s"), kinds(expected_notes, "note_type", "want_n")):
        j = j.join(t, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    said = zero(F.col("risk_signal_count")) + zero(F.col("note_count"))

    def recalled(want: str, have: str) -> Column:
        hit = F.size(F.array_intersect(want, F.coalesce(have, F.array().cast("array<string>"))))
        return F.when(F.coalesce(F.size(want), F.lit(0)) > 0, hit / F.size(want)).otherwise(1.0)

    return j.select(
        "doc_id", zero(F.col("fact_count")).alias("fact_count"), zero(F.col("expected_fact_count")).alias("expected_fact_count"), zero(F.col("note_count")).alias("note_count"), zero(F.col("risk_signal_count")).alias("risk_signal_count"),
        "fact_value_accuracy", F.coalesce("fact_cited", F.lit(1.0)).alias("fact_source_ref_completeness"),
        F.when(said > 0, (zero(F.col("s_cited")) + zero(F.col("n_cited"))) / said).otherwise(1.0).alias("source_ref_completeness"),
        recalled("want_s", "categories").alias("signal_category_recall"), recalled("want_n", "types").alias("note_type_recall"),
    )


def golden_metrics(summaries: DataFrame, statement_accuracies: DataFrame, balance: DataFrame) -> DataFrame:
    """(metric, value) over all cases; 0 everywhere without a case. Accuracy counts
    cases that expect facts, facts' completeness cases that have some."""
    mean = lambda c, when=None: F.coalesce(F.avg(F.when(when, F.col(c)) if when is not None else F.col(c)), F.lit(0.0))
    wide = summaries.agg(
        F.count("*").cast("double").alias("n_cases"), mean("source_ref_completeness").alias("avg_source_ref_completeness"), mean("fact_value_accuracy").alias("avg_fact_value_accuracy"),
        mean("fact_source_ref_completeness", F.col("fact_count") > 0).alias("avg_fact_source_ref_completeness"),
        mean("signal_category_recall").alias("avg_signal_category_recall"), mean("note_type_recall").alias("avg_note_type_recall"),
    )
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in wide.columns])
    out = wide.select(F.explode(rows).alias("m")).select("m.*")
    out = out.unionByName(average(statement_accuracies, "accuracy", "avg_statement_accuracy")).unionByName(balance)
    return out.crossJoin(F.broadcast(wide.select((F.col("n_cases") == 0).alias("none")))).select("metric", F.when(F.col("none"), 0.0).otherwise(F.col("value")).alias("value"))


def gate(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Thresholds (kind min or max, metric, threshold) with actual and status; a
    missing metric fails."""
    j = thresholds.join(metrics.select("metric", F.col("value").alias("actual")), "metric", "left")
    ok = F.when(F.col("kind") == "min", F.col("actual") >= F.col("threshold")).otherwise(F.col("actual") <= F.col("threshold"))
    return j.select("kind", "metric", "actual", "threshold", F.when(F.coalesce(ok, F.lit(False)), "passed").otherwise("failed").alias("status"))


def report_json(checks: DataFrame) -> DataFrame:
    """One row: the gate's result as JSON, failures first."""
    row = F.struct("status", "metric", "kind", "actual", "threshold")
    passed = F.bool_and(F.col("status") == "passed").alias("passed")
    return checks.agg(passed, F.array_sort(F.collect_list(row)).alias("checks")).select(F.to_json(F.struct(F.coalesce("passed", F.lit(True)).alias("passed"), "checks")).alias("report"))


def report_markdown(checks: DataFrame) -> DataFrame:
    """One row: the gate's result as a Markdown table, failures first."""
    line = F.format_string("| %s | %s | %s | %s | %s |", "status", "kind", "metric", F.coalesce(F.format_number("actual", 4), F.lit("-")), F.format_number("threshold", 4))
    rows = F.array_sort(F.collect_list(F.struct("status", "metric", line.alias("line"))))
    head = F.array(F.lit("| status | kind | metric | actual | threshold |"), F.lit("| --- | --- | --- | --- | --- |"))
    return checks.agg(F.array_join(F.concat(head, F.transform(rows, lambda r: r["line"])), "\n").alias("report"))
