"""Canonical facts and analyst corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingspark import dims
from filingspark.functions import numbers, text

REF = "struct<ref_type:string,page:int,table_id:string,row:int,col:int,bbox:array<double>,quote:string,confidence:double,engine:string,artifact_path:string>"
PERIOD_TYPES = ("instant", "duration", "unknown")


def fact_id(doc_id: Column, kind: Column, concept: Column, period_end: Column, label: Column) -> Column:
    raw = F.concat_ws("|", doc_id, kind, concept, F.coalesce(period_end.cast("string"), F.lit("")), label)
    return F.concat(F.lit("fact_"), F.left(F.sha1(raw), F.lit(16)))


def fallback_refs(first_page: Column) -> Column:
    """Evidence where there is none: the first page's first line, or a remark."""
    ref = lambda said, sure: F.array(F.struct(F.lit("page_text").alias("ref_type"), F.lit(1).alias("page"), *[F.lit(None).cast(t).alias(n) for n, t in (("table_id", "string"), ("row", "int"), ("col", "int"), ("bbox", "array<double>"))], said.alias("quote"), F.lit(sure).alias("confidence"), *[F.lit(None).cast("string").alias(n) for n in ("engine", "artifact_path")]).cast(REF))
    return F.when(first_page.isNotNull(), ref(text.quote(first_page), 0.2)).otherwise(ref(F.lit("Evidence unavailable"), 0.1))


def best_confidence(refs: Column, fallback: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(refs, lambda r: r["confidence"])), fallback)


def first_engine(refs: Column) -> Column:
    return F.get(F.filter(F.transform(refs, lambda r: r["engine"]), lambda e: e.isNotNull() & (e != "")), 0)


def build_facts(items: DataFrame, totals: DataFrame, statements: DataFrame) -> DataFrame:
    """Facts of line items that have a value or evidence, and of totals without a
    kept line item. ``statements``: (doc_id, statement_type, period_start,
    period_end, confidence)."""
    kept = items.where(F.col("statement_type").isin(*dims.CRITICAL) & (F.col("value_current").isNotNull() | (F.size("source_refs") > 0)))
    of_items = kept.select(
        "doc_id", "statement_type", F.col("name_norm").alias("concept"), F.col("name_raw").alias("label"), F.col("value_current").alias("value"),
        "unit", "currency", "source_refs", F.lit("line_item").alias("origin"), F.col("item_ord").cast("long").alias("ord"),
    )
    of_totals = totals.select(
        "doc_id", "statement_type", "concept", F.col("concept").alias("label"), "value",
        F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("currency"), F.array().cast(f"array<{REF}>").alias("source_refs"),
        F.lit("statement_totals").alias("origin"), F.lit(1_000_000).cast("long").alias("ord"),
    )
    # A total counts where no line item of its concept does; one shuffle for both.
    first = F.min("ord").over(Window.partitionBy("doc_id", "statement_type", "concept"))
    both = of_items.unionByName(of_totals).withColumn("first", first).where("ord = first or origin = 'line_item'").drop("first")
    both = both.join(statements, ["doc_id", "statement_type"], "left")
    return both.select(
        "doc_id",
        fact_id(F.col("doc_id"), F.col("statement_type"), F.col("concept"), F.col("period_end"), F.col("label")).alias("fact_id"),
        "statement_type", "concept", "label", "value", "unit", numbers.infer_scale(F.col("unit")).alias("scale"), "currency",
        "period_start", "period_end", F.when(F.col("statement_type") == "balance", "instant").otherwise("duration").alias("period_type"),
        "source_refs", best_confidence(F.col("source_refs"), F.col("confidence")).alias("confidence"),
        first_engine(F.col("source_refs")).alias("extraction_engine"), "origin", F.col("ord").alias("fact_ord"),
    )


def _typed(field: str, raw: Column) -> tuple[Column, Column]:
    """(value, valid) of a correction's JSON text for a field. A JSON null clears
    a field that may be null."""
    null, plain = F.trim(raw) == "null", F.regexp_replace(F.trim(raw), r'^"|"$', "")
    if field in ("value", "scale"):
        number = F.when(plain.rlike(numbers.FLOAT), plain.try_cast("double"))
        return number, null | number.isNotNull()
    if field in ("period_start", "period_end"):
        day = F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}$"), plain.try_cast("date"))
        return day, null | day.isNotNull()
    if field == "source_refs":
        refs = F.from_json(raw, f"array<{REF}>")
        return refs, F.trim(raw).startswith("[") & refs.isNotNull()
    if field == "period_type":
        return plain, plain.isin(*PERIOD_TYPES)
    if field == "statement_type":
        return plain, plain.isin(*dims.CRITICAL)
    quoted = F.trim(raw).rlike('^".*"$')
    return F.when(quoted, plain), quoted if field in ("concept", "label") else quoted | null


def correction_field(name: Column) -> Column:
    return F.when(name == "evidence", "source_refs").otherwise(name)


def corrected_facts(facts: DataFrame, corrections: DataFrame, fields=dims.CORRECTABLE) -> DataFrame:
    """Facts with, per field, the last valid correction (fact_id, corr_ord,
    field_name, new_value as JSON text); unknown fields, unknown facts and values
    of a wrong type are passed over. Facts that share an id collapse to the last."""
    one = facts.groupBy("fact_id").agg(F.max_by(F.struct(*[c for c in facts.columns if c != "fact_id"]), "fact_ord").alias("f")).select("fact_id", "f.*")
    c = corrections.select("fact_id", "corr_ord", correction_field(F.col("field_name")).alias("field"), "new_value").where(F.col("field").isin(*fields))
    last = []
    for f in fields:
        value, valid = _typed(f, F.col("new_value"))
        ok = (F.col("field") == f) & valid
        last.append(F.max_by(F.when(ok, F.struct(value.alias("v"))), F.when(ok, F.col("corr_ord"))).alias(f"_{f}"))
    pivot = c.groupBy("fact_id").agg(*last, F.count("*").alias("n_corrections"))
    joined = one.join(pivot, "fact_id", "left")
    out = [F.when(F.col(f"_{x}").isNotNull(), F.col(f"_{x}.v")).otherwise(F.col(x)).alias(x) if x in fields else F.col(x) for x in facts.columns]
    return joined.select(*out, F.coalesce("n_corrections", F.lit(0)).alias("n_corrections"))


def _json(value: Column) -> Column:
    """A value as JSON text, null included."""
    return F.coalesce(F.nullif(F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit("")), F.lit("null"))


def _typed_corrections(corrections: DataFrame, fields) -> DataFrame:
    """(fact_id, corr_ord, field, new_value, given, applied) of corrections of known fields."""
    given = F.col("old_value") if "old_value" in corrections.columns else F.lit(None).cast("string")
    c = corrections.select("fact_id", "corr_ord", correction_field(F.col("field_name")).alias("field"), "new_value", given.alias("given")).where(F.col("field").isin(*fields))
    valid = F.coalesce(*[F.when(F.col("field") == f, F.coalesce(_typed(f, F.col("new_value"))[1], F.lit(False))) for f in fields])
    return c.withColumn("applied", valid)


def _with_own(corrections: DataFrame, facts: DataFrame, fields) -> DataFrame:
    """Corrections of known facts, with ``own``, the fact's own value of the field as JSON."""
    own = [_json(F.col(f) if f in facts.columns else F.lit(None).cast("string")).alias(f) for f in fields]
    one = facts.groupBy("fact_id").agg(F.max_by(F.struct(*own), "fact_ord").alias("f"))
    of_field = F.coalesce(*[F.when(F.col("field") == f, F.col(f"f.{f}")) for f in fields])
    return corrections.join(one, "fact_id").withColumn("own", of_field).drop("f")


def checked_corrections(corrections: DataFrame, facts: DataFrame, fields=dims.CORRECTABLE) -> DataFrame:
    """(fact_id, corr_ord, field, new_value, given, own, applied) of the corrections of
    known facts and fields: ``given`` is the old value a correction came with, if it has
    one, ``own`` the fact's own, both as JSON; a value of a wrong type is not applied."""
    c = _with_own(_typed_corrections(corrections, fields), facts, fields)
    return c.select("fact_id", "corr_ord", "field", "new_value", "given", "own", "applied")


def _placed(corrections: DataFrame, fields) -> DataFrame:
    """Corrections with ``last``, the new value of the one applied last to the field before them, and ``place``, 1 for
    a fact's newest. Both come of one order of a fact's corrections, so that they are sorted once."""
    order = Window.partitionBy("fact_id").orderBy("corr_ord", F.desc("field"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda f: F.last(F.when(F.col("applied") & (F.col("field") == f), F.col("new_value")), ignorenulls=True).over(before)
    n = F.count("*").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    w = corrections.withColumns({"place": (n - F.row_number().over(order) + 1).cast("int")} | {f"_{f}": last(f) for f in fields})
    return w.withColumn("last", F.coalesce(*[F.when(F.col("field") == f, F.col(f"_{f}")) for f in fields])).drop(*[f"_{f}" for f in fields])


def correction_history(checked: DataFrame, fields=dims.CORRECTABLE) -> DataFrame:
    """(fact_id, corr_ord, field, old_value, new_value, applied, place): every correction
    with the value before it, the one it came with or that of the last one applied to
    the field, or the fact's own; place 1 is a fact's newest."""
    return _placed(checked, fields).select("fact_id", "corr_ord", "field", F.coalesce("given", "last", "own").alias("old_value"), "new_value", "applied", "place")


def history(corrections: DataFrame, facts: DataFrame, fields=dims.CORRECTABLE) -> DataFrame:
    """``correction_history`` of corrections that are not checked yet: they are placed before they meet their facts, so
    that one sort by fact serves both and no fact's values are sorted along."""
    return _with_own(_placed(_typed_corrections(corrections, fields), fields), facts, fields).select("fact_id", "corr_ord", "field", F.coalesce("given", "last", "own").alias("old_value"), "new_value", "applied", "place")


def fact_values(facts: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """A row per document: the first value of each (statement type, concept)."""
    is_ = lambda k, c: (F.col("statement_type") == k) & (dims.canonical(F.col("concept")) == c) & F.col("value").isNotNull()
    return facts.groupBy("doc_id").agg(*[F.min_by(F.when(is_(k, c), F.col("value")), F.when(is_(k, c), F.col("fact_ord"))).alias(n) for n, (k, c) in wanted.items()])
