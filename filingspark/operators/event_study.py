"""Event studies over price series: windows, market model, significance.

Prices (ticker, trade_date, close, volume) are indexed once per ticker; events
(ticker, event_date) meet them by equi-joins on ticker, and the windows are row
ranges of that index. Returns come from the whole series, so that the market
model has its estimation rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingspark.functions.numbers import normal_cdf

WINDOWS = ((-1, 1), (-3, 3), (-5, 5))
ESTIMATION_ROWS = 120
MIN_ALIGNED, MIN_ESTIMATION, MIN_VARIANCE = 10, 20, 1e-12


def indexed(prices: DataFrame) -> DataFrame:
    """Prices with idx, the trading day's number, and ret, the day's return."""
    w = Window.partitionBy("ticker").orderBy("trade_date")
    ret = F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0))
    return prices.withColumn("idx", F.row_number().over(w) - 1).withColumn("ret", ret)


def locate_events(series: DataFrame, events: DataFrame) -> DataFrame:
    """Events with event_idx: the first trading day on or after the event; after
    the last one the first row of the series, with event_matched false. Events
    and days meet in one ordered window of a ticker, not pair by pair."""
    asked = events.select("ticker", F.col("event_date").alias("trade_date"), F.lit(None).cast("int").alias("idx"), F.lit(True).alias("asked"))
    both = series.select("ticker", "trade_date", "idx", F.lit(False).alias("asked")).unionByName(asked)
    on = F.min("idx").over(Window.partitionBy("ticker").orderBy("trade_date").rangeBetween(Window.currentRow, Window.unboundedFollowing))
    first = F.min("idx").over(Window.partitionBy("ticker"))
    out = both.withColumn("on", on).withColumn("first", first).where("asked and first is not null")
    return out.select("ticker", F.col("trade_date").alias("event_date"), F.coalesce("on", "first").alias("event_idx"), F.col("on").isNotNull().alias("event_matched")).distinct()


def event_study(prices: DataFrame, bench: DataFrame, events: DataFrame, windows=WINDOWS) -> DataFrame:
    """A row per (ticker, event_date, pre, post)."""
    series = indexed(prices)
    b = bench.select(F.lit("-").alias("ticker"), "trade_date", "close")
    market = indexed(b).select("trade_date", F.col("ret").alias("bm_ret"))
    pairs = F.array(*[F.struct(F.lit(a).alias("pre"), F.lit(z).alias("post")) for a, z in windows])
    asked = locate_events(series, events).select("*", F.explode(pairs).alias("w")).select("ticker", "event_date", "event_idx", "event_matched", "w.pre", "w.post")
    at = series.join(market, "trade_date", "left")
    key = ["ticker", "event_date", "pre", "post"]
    inside = F.col("idx").between(F.col("event_idx") + F.col("pre"), F.col("event_idx") + F.col("post"))
    est_end = F.greatest(F.col("event_idx") + F.col("pre") - 1, F.lit(0))
    estimating = (F.col("idx") >= F.greatest(est_end - ESTIMATION_ROWS, F.lit(0))) & (F.col("idx") < est_end)
    # An event asks for its rows by number: a bounded range, joined on equality.
    wanted = F.sequence(F.least(F.col("event_idx") + F.col("pre"), F.greatest(est_end - ESTIMATION_ROWS, F.lit(0))), F.greatest(F.col("event_idx") + F.col("post"), est_end))
    rows = asked.withColumn("idx", F.explode(wanted)).join(at, ["ticker", "idx"])
    rows = rows.withColumn("inside", inside).withColumn("estimating", estimating & F.col("bm_ret").isNotNull()).where(inside | estimating)
    step = Window.partitionBy(*key).orderBy("idx")
    rows = rows.withColumn("wret", F.when(F.col("inside"), F.coalesce(F.col("close") / F.lag(F.when(F.col("inside"), F.col("close"))).over(step) - 1, F.lit(0.0))))
    y, x = F.when(F.col("estimating"), F.col("ret")), F.when(F.col("estimating"), F.col("bm_ret"))
    ev = F.col("inside") & F.col("bm_ret").isNotNull()
    ey, ex = F.when(ev, F.col("ret")), F.when(ev, F.col("bm_ret"))
    aligned = at.groupBy("ticker").agg(F.count("bm_ret").alias("n_aligned"))
    s = rows.groupBy(*key, "event_idx", "event_matched").agg(
        F.max_by(F.when(F.col("inside"), F.col("close")), F.when(F.col("inside"), F.col("idx"))).alias("last"),
        F.min_by(F.when(F.col("inside"), F.col("close")), F.when(F.col("inside"), F.col("idx"))).alias("first"),
        F.stddev_samp("wret").alias("std_dev"),
        F.avg(F.when(F.col("inside"), F.col("volume"))).alias("mean_volume"),
        F.max(F.when(F.col("inside"), F.col("volume"))).alias("max_volume"),
        F.count(y).alias("n_est"), F.avg(y).alias("my"), F.avg(x).alias("mx"), F.covar_pop(y, x).alias("cov"), F.var_pop(x).alias("var"),
        F.count(ey).alias("n_ev"), F.sum(ey).alias("sy"), F.sum(ex).alias("sx"),
        F.var_samp(ey).alias("vy"), F.var_samp(ex).alias("vx"), F.covar_samp(ey, ex).alias("cxy"),
    )
    s = s.join(aligned, "ticker")
    usable = (F.col("n_aligned") >= MIN_ALIGNED) & (F.col("n_est") >= MIN_ESTIMATION) & (F.col("var") >= MIN_VARIANCE) & (F.col("n_ev") > 0)
    s = s.withColumn("beta", F.when(usable, F.col("cov") / F.col("var"))).withColumn("alpha", F.col("my") - F.col("beta") * F.col("mx"))
    # An abnormal return is y - alpha - beta x, so its sum and its variance follow.
    car = F.col("sy") - F.col("n_ev") * F.col("alpha") - F.col("beta") * F.col("sx")
    spread = F.sqrt(F.greatest(F.col("vy") - 2 * F.col("beta") * F.col("cxy") + F.col("beta") * F.col("beta") * F.col("vx"), F.lit(0.0)))
    s = s.withColumn("car", car).withColumn("mean_ar", F.col("car") / F.col("n_ev")).withColumn("spread", spread)
    flat = (F.col("n_ev") < 2) | (F.col("spread") < 1e-12)
    t = F.when(F.col("beta").isNotNull(), F.when(flat, 0.0).otherwise(F.col("mean_ar") / (F.col("spread") / F.sqrt("n_ev"))))
    s = s.withColumn("t_stat", t).withColumn("p_value", F.when(flat & F.col("beta").isNotNull(), 1.0).otherwise(2 * normal_cdf(-F.abs("t_stat"))))
    return s.select(*key, "event_matched", (F.col("last") / F.col("first") - 1).alias("cumulative_return"), "std_dev", "mean_volume", "max_volume", "alpha", "beta", "car", "mean_ar", "t_stat", "p_value")


def nearest_close(days: DataFrame, bench: DataFrame) -> DataFrame:
    """(trade_date, bm_close) for ``days`` (trade_date): the benchmark's close of the
    nearest day at any distance, the later of two equally near ones. One window
    orders the calendar's days, whose number no market makes large."""
    b = bench.select("trade_date", F.col("close").alias("bm_close"))
    marked = days.select("trade_date").distinct().join(b, "trade_date", "full_outer")
    known = F.when(F.col("bm_close").isNotNull(), F.struct(F.col("trade_date").alias("day"), F.col("bm_close").alias("close")))
    w = Window.orderBy("trade_date")
    before = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = marked.withColumn("before", before).withColumn("after", after)
    nearer = F.datediff(F.col("trade_date"), F.col("before.day")) < F.datediff(F.col("after.day"), F.col("trade_date"))
    close = F.when(F.col("after").isNull() | nearer, F.col("before.close")).otherwise(F.col("after.close"))
    return near.select("trade_date", close.alias("bm_close"))


def indexed_to_100(prices: DataFrame, bench: DataFrame) -> DataFrame:
    """Closes and the nearest benchmark close, both at 100 on the ticker's first day."""
    w = Window.partitionBy("ticker").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    j = prices.join(nearest_close(prices, bench), "trade_date", "left")
    return j.select("ticker", "trade_date", (F.col("close") / F.first("close").over(w) * 100).alias("stock_index"), (F.col("bm_close") / F.first("bm_close").over(w) * 100).alias("bench_index"))
