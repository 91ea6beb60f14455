"""Structured Streaming: admission, task status, corrections, run metrics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingspark.operators import facts, listing
from filingspark.sources import sinks

ADMIT_SECONDS = 60


def admitted(times: list[float], accepted: list[float], limit: int, seconds: float = ADMIT_SECONDS) -> tuple[list[bool], list[float]]:
    """Whether each time, in order, is let in: fewer than ``limit`` accepted ones
    within ``seconds`` before it. Only accepted times count."""
    out = []
    for t in times:
        accepted = [a for a in accepted if t - a < seconds]
        out.append(len(accepted) < limit)
        if out[-1]:
            accepted.append(t)
    return out, accepted


def admission(events: DataFrame, limit: int, seconds: float = ADMIT_SECONDS) -> DataFrame:
    """(key, ts, admitted) of a stream (key, ts) per key, in event-time order
    within a batch. A key's state is its accepted times, at most ``limit``."""

    def fold(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        allowed, held = admitted((rows["ts"].astype("int64") / 1e9).tolist() if str(rows["ts"].dtype) == "datetime64[ns]" else [t.timestamp() for t in rows["ts"]], held, limit, seconds)
        state.update((held,))
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"], "admitted": allowed})

    return events.groupBy("key").applyInPandasWithState(fold, "key long, ts timestamp, admitted boolean", "accepted array<double>", "append", "NoTimeout")


def admission_batch(events: DataFrame, limit: int, seconds: float = ADMIT_SECONDS) -> DataFrame:
    """The same over a table, as an ordered fold of each key's times."""
    def step(acc, t):
        live = F.filter(acc["held"], lambda a: t - a < seconds)
        ok = F.size(live) < limit
        return F.struct(F.when(ok, F.concat(live, F.array(t))).otherwise(live).alias("held"), F.concat(acc["out"], F.array(F.struct(t.alias("t"), ok.alias("admitted")))).alias("out"))

    zero = F.struct(F.array().cast("array<double>").alias("held"), F.array().cast("array<struct<t:double,admitted:boolean>>").alias("out"))
    times = events.groupBy("key").agg(F.array_sort(F.collect_list(F.unix_micros("ts") / 1e6)).alias("t"))
    return times.select("key", F.explode(F.aggregate("t", zero, step, lambda a: a["out"])).alias("o")).select("key", F.timestamp_micros((F.col("o.t") * 1e6).cast("long")).alias("ts"), "o.admitted")


def run_metrics(log: DataFrame, delay: str = "10 minutes", window: str = "1 day") -> DataFrame:
    """(window start, label, n, total) of a run log (ts, label, value), by event
    time; late rows beyond ``delay`` are left out in a stream."""
    w = log.withWatermark("ts", delay) if log.isStreaming else log
    agg = w.groupBy(F.window("ts", window).alias("w"), "label").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    return agg.select(F.col("w.start").alias("start"), "label", "n", F.col("total").cast("double").alias("total"))


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there and gives its output as a table, written
    beside the session's checkpoints."""
    spark = stream.sparkSession
    folder = sinks.scratch(spark, "stream")
    if mode == "update":
        # Of the rows of a key the last batch's counts.
        out = stream.writeStream.outputMode("update").foreachBatch(lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/batch_no={n}"))
    elif mode == "complete":
        out = stream.writeStream.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{folder}/out"))
    else:
        out = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out")
    out.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if mode == "update":
        key = stream.columns[0]
        rows = spark.read.schema(f"{stream._jdf.schema().toDDL()}, batch long").parquet(f"{folder}/out/*")
        return rows.groupBy(key).agg(F.max_by(F.struct(*stream.columns), "batch").alias("r")).select("r.*")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def status_stream(events: DataFrame) -> DataFrame:
    """(doc_id, status, progress, current_node, error_message) of the documents that a
    batch of task events (doc_id, ts, event_ord, status, progress, current_node,
    error_message) concerns, in update mode. A document's state is its merged row with
    the time of each field, so a batch costs what it holds."""
    fields = ("status", "progress", "current_node", "error_message")

    def merge(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [None, None] * len(fields)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_ord"], kind="stable")
        for n, field in enumerate(fields):
            said = rows[rows[field].notna()]
            if len(said):
                last = said.iloc[-1]
                at = f"{pd.Timestamp(last['ts']).value:020d}:{int(last['event_ord']):020d}"
                if held[2 * n + 1] is None or held[2 * n + 1] <= at:
                    held[2 * n : 2 * n + 2] = [str(int(last[field])) if field == "progress" else last[field], at]
        state.update(tuple(held))
        status, progress, node, error = held[::2]
        yield pd.DataFrame({"doc_id": [key[0]], "status": [status or "queued"], "progress": [int(progress or 0)], "current_node": [node], "error_message": [error]})

    kind = events.schema["doc_id"].dataType.simpleString()
    state = ", ".join(f"{f} string, {f}_at string" for f in fields)
    out = f"doc_id {kind}, status string, progress int, current_node string, error_message string"
    return events.groupBy("doc_id").applyInPandasWithState(merge, out, state, "update", "NoTimeout")


def correction_stream(checked: DataFrame) -> DataFrame:
    """(fact_id, corr_ord, field, old_value, new_value, applied) of a stream of checked
    corrections, in append mode: the history as it grows. A fact's state is its fields'
    last applied values, so a batch costs what it holds. A correction that comes after a
    later one of its field is listed, and not applied."""

    def follow(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        names, values, ords = (list(x) for x in state.get) if state.exists else ([], [], [])
        held = dict(zip(names, zip(values, ords, strict=True), strict=True))
        out = []
        rows = [row for b in batches for row in zip(*(b[c].tolist() for c in ("corr_ord", "field", "new_value", "given", "own", "applied")), strict=True)]
        for corr_ord, field, new, given, own, ok in sorted(rows, key=lambda r: r[0]):
            value, at = held.get(field, (None, None))
            applied = bool(ok) and (at is None or at < corr_ord)
            old = given if isinstance(given, str) else value if value is not None else own
            out.append((key[0], corr_ord, field, old, new, applied))
            if applied:
                held[field] = (new, corr_ord)
        state.update((list(held), [v for v, _ in held.values()], [int(n) for _, n in held.values()]))
        yield pd.DataFrame(out, columns=["fact_id", "corr_ord", "field", "old_value", "new_value", "applied"])

    schema = "fact_id string, corr_ord long, field string, old_value string, new_value string, applied boolean"
    return checked.groupBy("fact_id").applyInPandasWithState(follow, schema, "fields array<string>, vals array<string>, ords array<long>", "append", "NoTimeout")


def duration_stream(log: DataFrame, bounds: list[float], delay: str = "10 minutes", window: str = "1 day") -> DataFrame:
    """(start, label, le, n): per window and label how many values are at most each
    bound, of a run log (ts, label, value); counts of a batch and of the state add up."""
    w = log.withWatermark("ts", delay) if log.isStreaming else log
    counts = [F.count_if(F.col("value") <= b).alias(f"n{k}") for k, b in enumerate(bounds)]
    agg = w.groupBy(F.window("ts", window).alias("w"), "label").agg(*counts)
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"n{k}").alias("n")) for k, b in enumerate(bounds)])
    return agg.select(F.col("w.start").alias("start"), "label", F.explode(rows).alias("r")).select("start", "label", "r.le", "r.n")


def follow_status(events: DataFrame, read, upsert, checkpoint: str):
    """Starts the stream that keeps task status: the documents of a batch are
    merged with what ``read()`` knows of them and handed to ``upsert(df)``; others
    are left alone."""

    def merge(batch: DataFrame, _: int) -> None:
        state = read()
        if state is not None:
            touched = state.join(batch.select("doc_id").distinct(), "doc_id", "left_semi")
            old = touched.select("doc_id", F.lit(None).cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("event_ord"), "status", "progress", "current_node", "error_message")
            batch = old.unionByName(batch.select(*old.columns))
        upsert(listing.task_status(batch))

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_corrections(corrections: DataFrame, facts_table: DataFrame, read_log, append_log, write, checkpoint: str):
    """Starts the stream that keeps effective facts: a batch is added to the log
    and only the facts it touches are corrected anew from the whole log."""

    def apply(batch: DataFrame, _: int) -> None:
        append_log(batch)
        touched = batch.select("fact_id").distinct()
        log = read_log().join(touched, "fact_id", "left_semi")
        write(facts.corrected_facts(facts_table.join(touched, "fact_id", "left_semi"), log))

    return corrections.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
