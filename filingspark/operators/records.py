"""Typed records: domain checks, bundles in JSON text, repair of statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingspark.functions import text
from filingspark.operators.facts import REF, fallback_refs
from filingspark.operators.signals import SEVERITIES

# The domains of typed fields.
NOTE_TYPES = ("accounting_policy", "audit_opinion", "related_party", "impairment", "contingency", "segment", "guidance", "other")
CATEGORIES = ("cash_vs_profit", "accruals", "one_offs", "audit_governance", "disclosure_inconsistency", "working_capital", "other")
REF_TYPES = ("page_text", "table", "image")
NOTE = f"struct<note_type:string,summary:string,source_refs:array<{REF}>>"
SIGNAL = f"struct<signal_id:string,category:string,title:string,severity:string,description:string,metrics:map<string,string>,evidence:array<{REF}>>"


def valid_ref(r: Column) -> Column:
    share = lambda x: x.isNull() | x.between(0, 1)
    return F.coalesce(r["ref_type"].isin(*REF_TYPES) & r["page"].isNotNull() & share(r["confidence"]), F.lit(False))


def _refs_ok(refs: Column) -> Column:
    return F.coalesce(F.forall(refs, valid_ref), F.lit(True))


def valid_note(n: Column) -> Column:
    return F.coalesce(n["note_type"].isin(*NOTE_TYPES) & n["summary"].isNotNull(), F.lit(False)) & _refs_ok(n["source_refs"])


def valid_signal(s: Column) -> Column:
    known = s["category"].isin(*CATEGORIES) & s["severity"].isin(*SEVERITIES)
    given = s["signal_id"].isNotNull() & s["title"].isNotNull() & s["description"].isNotNull()
    return F.coalesce(known & given, F.lit(False)) & _refs_ok(s["evidence"])


def valid_cell(df: DataFrame) -> DataFrame:
    """Cells with ``valid``: spans of at least one, confidence within 0 and 1."""
    span = lambda c: F.coalesce(F.col(c), F.lit(1)) >= 1
    return df.withColumn("valid", span("rowspan") & span("colspan") & (F.col("confidence").isNull() | F.col("confidence").between(0, 1)))


def _bundle(raw: Column, record: str, field: str, valid) -> Column:
    body = text.json_candidate(raw)
    as_list = F.when(body.startswith("["), F.filter(F.from_json(body, f"array<{record}>"), valid))
    held = F.from_json(body, f"struct<{field}:array<{record}>>")[field]
    # An object counts as a whole: one invalid record makes it empty.
    as_object = F.when(body.startswith("{") & F.coalesce(F.forall(held, valid), F.lit(False)), held)
    return F.coalesce(as_list, as_object, F.array().cast(f"array<{record}>"))


def notes_of(raw: Column) -> Column:
    """Valid notes of model text: an object with ``notes``, or a bare list whose
    invalid records drop."""
    return _bundle(raw, NOTE, "notes", valid_note)


def signals_of(raw: Column) -> Column:
    """Valid signals of model text: ``risk_signals`` of an object, or a list."""
    return _bundle(raw, SIGNAL, "risk_signals", valid_signal)


def quarantine(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) rows; what cannot be decided is rejected."""
    sure = F.coalesce(ok, F.lit(False))
    return df.where(sure), df.where(~sure)


def repaired(statements: DataFrame, items: DataFrame, pages: DataFrame) -> DataFrame:
    """Line items of every statement (doc_id, statement_type): a placeholder where
    there is none, and fallback evidence for items without evidence."""
    none = statements.select("doc_id", "statement_type").join(items.select("doc_id", "statement_type").distinct(), ["doc_id", "statement_type"], "left_anti")
    holder = none.select("doc_id", "statement_type", F.lit(1).alias("item_ord"), F.lit("unknown").alias("name_raw"), F.lit("unknown").alias("name_norm"), F.lit("missing_data").alias("notes"))
    both = items.unionByName(holder, allowMissingColumns=True)
    first = pages.where("page_number = 1").select("doc_id", F.col("text").alias("_first"))
    empty = F.coalesce(F.size("source_refs"), F.lit(0)) <= 0
    return both.join(first, "doc_id", "left").withColumn("source_refs", F.when(empty, fallback_refs(F.col("_first"))).otherwise(F.col("source_refs"))).drop("_first")


def filtered_signals(signals: DataFrame, severity: str = "all", category: str = "all") -> DataFrame:
    """Signals of a severity and a category; ``all`` filters nothing."""
    if severity != "all":
        signals = signals.where(F.col("severity") == severity)
    return signals if category == "all" else signals.where(F.col("category") == category)


def fitted_prompt(system: Column, user: Column, limit: int, reserve: int = 4_096) -> Column:
    """The user's text cut so that it and the system text fit a window."""
    return text.truncated(user, F.greatest(F.lit(limit - reserve) - text.estimated_tokens(system), F.lit(0)))
