"""Chat formatting (native): budgeted windows over conversations.

A turn costs its words plus ``TURN_OVERHEAD``. Prefix sums of the costs assign
turns to windows: a window takes the turns that lie within one stretch of
``room`` tokens, and a turn that crosses a stretch's end is a window of its own,
so only a single turn can be longer than its window. Every window begins with
the conversation's system turn (if its first turn is one) and up to
``history_turns`` earlier turns within ``history_tokens``. The loss mask holds
the text of the assistant turns that are new in the window; repeated ones are
masked, so each is trained on once.

The template marks a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside
texts and roles ``&`` and ``<|`` become ``&amp;`` and ``&lt;|`` (and a line feed
in a role ``&nl;``), which is reversible and leaves no control string.

Defined cases: null text or role counts as empty, null turns come first; turns
that repeat a number are ordered by role and text; repeated rows are turns each;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, words

BUDGET = 1024
HISTORY_TURNS = 4
HISTORY_TOKENS = 256
TURN_OVERHEAD = 4
START, END = "<|im_start|>", "<|im_end|>\n"


def _replaced(x: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def escape(x: Column) -> Column:
    return _replaced(x, ("&", "&amp;"), ("<|", "&lt;|"))


def unescape(x: Column) -> Column:
    return _replaced(x, ("&lt;|", "<|"), ("&amp;", "&"))


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), _replaced(escape(role), ("\n", "&nl;")), F.lit("\n"), escape(text), F.lit(END))


def _last_within(turns: Column, budget: int) -> Column:
    """The longest tail of an array of turns that costs at most ``budget``."""
    zero = F.struct(F.lit(0).cast("long").alias("cost"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(acc, t):
        fits = acc["open"] & (acc["cost"] + t["tokens"] <= budget)
        return F.struct((acc["cost"] + t["tokens"]).alias("cost"), (acc["n"] + fits.cast("int")).alias("n"), fits.alias("open"))

    return let(turns, lambda a: let(F.aggregate(F.reverse(a), zero, step, lambda acc: acc["n"]), lambda n: F.slice(a, F.size(a) - n + 1, n)))


def format_chat(turns: DataFrame, *, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """A row per window: conv_id, window (rising), n_repeated (leading turns that
    repeat), formatted, and loss_spans, code-point ranges of the trained text."""
    cost = (F.size(words(F.col("text"))) + TURN_OVERHEAD).cast("long")
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("tokens", cost)
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = by_turn.rowsBetween(Window.unboundedPreceding, 0)
    t = (
        t.withColumn("pos", F.row_number().over(by_turn))
        .withColumn("end", F.sum("tokens").over(upto))
        .withColumn("system", F.first(F.when(F.col("role") == "system", F.struct("role", "text", "tokens"))).over(upto))
    )
    system_cost = F.coalesce(F.col("system.tokens"), F.lit(0))
    is_system = (F.col("pos") == 1) & F.col("system").isNotNull()
    t = (
        t.withColumn("room", F.greatest(budget - system_cost - history_tokens, F.lit(budget // 4)))
        .withColumn("end", F.greatest(F.col("end") - system_cost, F.lit(0)))
        .withColumn("start", F.when(is_system, 0).otherwise(F.col("end") - F.col("tokens")))
        .withColumn("stretch", F.expr("start div room"))
        .withColumn("window", F.when(is_system, 0).otherwise(2 * F.col("stretch") + (F.expr("(end - 1) div room") > F.col("stretch")).cast("int")))
    )
    earlier = F.collect_list(F.struct("window", "role", "text", "tokens", is_system.alias("is_system"))).over(by_turn.rowsBetween(-history_turns, -1))
    past = F.filter("earlier", lambda e: (e["window"] < F.col("window")) & ~e["is_system"])
    new_window = F.col("window") != F.coalesce(F.lag("window").over(by_turn), F.lit(-1))
    t = t.withColumn("earlier", earlier).withColumn("first", new_window)
    t = t.withColumn("past", F.when(F.col("first"), _last_within(past, history_tokens)))
    w = t.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"),
        F.min_by("past", "pos").alias("past"),
        F.min_by("system", "pos").alias("system"),
    )
    head = F.when((F.col("window") > 0) & F.col("system").isNotNull() & (F.col("turns")[0]["pos"] > 1), F.array(_rendered(F.col("system.role"), F.col("system.text")))).otherwise(F.array().cast("array<string>"))
    repeated = F.concat(head, F.transform("past", lambda e: _rendered(e["role"], e["text"])))
    fresh = F.transform("turns", lambda e: _rendered(e["role"], e["text"]))
    w = w.withColumn("repeated", repeated).withColumn("fresh", fresh)

    def spans(s):
        zero = F.struct(s["at"].alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

        def step(acc, e):
            end = acc["at"] + F.length(_rendered(e["role"], e["text"]))
            stop = end - len(END)
            span = F.struct((stop - F.length(escape(e["text"]))).alias("start"), stop.alias("end"))
            return F.struct(end.alias("at"), F.when(e["role"] == "assistant", F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(s["turns"], zero, step, lambda acc: acc["out"])

    before = F.array_join("repeated", "")
    return w.select(
        "conv_id",
        "window",
        F.size("repeated").alias("n_repeated"),
        F.concat(before, F.array_join("fresh", "")).alias("formatted"),
        let(F.struct(F.length(before).alias("at"), F.col("turns").alias("turns")), spans).alias("loss_spans"),
    )


def read_chat(windows: DataFrame) -> DataFrame:
    """A row per conversation, read back from the formatted windows alone:
    turns (array of role, text), loss_texts and formatted_chars."""

    def turn(x):
        body = F.substr(x, F.lit(len(START) + 1))
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescape(_replaced(role, ("&nl;", "\n"))).alias("role"), unescape(F.substr(body, F.length(role) + 2)).alias("text"))

    marked = F.split("formatted", r"<\|im_end\|>\n")
    fresh = let(marked, lambda a: F.slice(a, F.col("n_repeated") + 1, F.size(a) - 1 - F.col("n_repeated")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["end"] - s["start"])))
    parsed = windows.select("conv_id", "window", F.transform(fresh, turn).alias("turns"), loss.alias("loss"), F.length("formatted").alias("n"))
    ordered = parsed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("n").alias("formatted_chars"))
    return ordered.select(
        "conv_id",
        F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"),
        F.flatten(F.transform("w", lambda x: x["loss"])).alias("loss_texts"),
        "formatted_chars",
    )
