"""Ticks and candles into longer candles; trims of what a duration does not use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickwork.functions.candles import SERIES
from wickwork.functions.timegrid import slot_start

#: Hours before settlement from which a duration is used, the durations fetched as such, and warm-up minutes.
START_HOURS = {
    5: 48, 10: 96, 15: 192, 20: 288, 30: 384, 40: 384, 45: 576, 60: 960, 90: 960, 120: 960,
    180: 960, 240: 960, 360: 960, 480: 960, 720: 960, 1440: 960,
}
DIRECT = (5, 15, 30, 60, 120, 240, 360, 1440)
WARMUP_MINUTES = 100
#: Rows of one task where windows or groups follow, which hold a task's rows in memory.
TASK_ROWS = 100_000


def ticks_to_candles(ticks: DataFrame, duration: int, by: list[str], seq: str = "seq") -> DataFrame:
    """Candles of `duration` minutes per `by` from (ts, price, qty); ticks of one instant stand in the order of `seq`."""
    at = F.struct("ts", seq)
    grouped = ticks.groupBy(*by, slot_start("ts", duration).alias("slot")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("qty").alias("volume")
    )
    return grouped.withColumnRenamed("slot", "ts").withColumn("duration", F.lit(duration))


def rollup(candles: DataFrame, duration: int, series: list[str] | None = None) -> DataFrame:
    """Candles of `duration` minutes from finer ones. Lows of zero are ignored unless all are zero."""
    by = [c for c in series or SERIES if c != "duration"]
    return rollup_many(candles, candles.select(F.lit(duration).alias("duration")).limit(1), by, None)


def sources_for(durations: list[int], bases: tuple[int, ...] = DIRECT) -> list[tuple[int, int]]:
    """(duration, base) with the largest base that divides the duration; durations without one are left out."""
    found = [(d, max((b for b in bases if d % b == 0), default=0)) for d in durations]
    return [(d, b) for d, b in found if b]


def rollup_many(candles: DataFrame, targets: DataFrame | list[int], by: list[str] | None = None, bases: tuple[int, ...] | None = DIRECT) -> DataFrame:
    """Candles of several durations in one grouped pass, each from the largest stored base that divides it.

    With `bases` None every candle feeds each target.
    """
    by = by or [c for c in SERIES if c != "duration"]
    if bases is None:
        plan = targets.withColumnRenamed("duration", "to")
        fine = candles.drop("duration").crossJoin(F.broadcast(plan))
    else:
        plan = candles.sparkSession.createDataFrame(sources_for(list(targets), bases), "to int, duration int")
        fine = candles.join(F.broadcast(plan), "duration").drop("duration")
    return grouped_candles(fine, by)


def grouped_candles(fine: DataFrame, by: list[str]) -> DataFrame:
    """Candles of the durations in column `to`, from candles that each feed one of them."""
    low = F.when(F.col("low") != 0, F.col("low"))
    grouped = fine.groupBy(*by, F.col("to").alias("duration"), slot_start("ts", F.col("to")).alias("slot")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.coalesce(F.min(low), F.lit(0.0)).alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    )
    return grouped.withColumnRenamed("slot", "ts")


def spread(df: DataFrame, rows: int, by: list[str] | None = None) -> DataFrame:
    """Rows dealt by series, or by columns `by`, over a task for each TASK_ROWS of about `rows`; windows and groups by these columns or more need no further shuffle.

    Shuffled bytes do not tell what a task will hold: constant columns shrink to nothing in them. No series is split.
    """
    return df.repartition(max(1, -(-rows // TASK_ROWS)), *(by or SERIES))


def gapless(candles: DataFrame, series: list[str] | None = None) -> DataFrame:
    """Each candle opens at the close before it, high and low widened to hold that price.

    Read from the end, as with_peak_after reads, so that both share a sort.
    """
    before = F.lead("close").over(Window.partitionBy(*(series or SERIES)).orderBy(F.desc("ts")))
    opened = candles.withColumn("open", F.coalesce(before, F.col("open")))
    return opened.withColumns({"high": F.greatest("high", "open"), "low": F.least("low", "open")})


def trim_dte(candles: DataFrame, settle: str = "settle_ts", windows: dict[int, float] | None = None) -> DataFrame:
    """Candles no earlier than a duration's window, plus an hour, before settlement; there is no end. An unknown settlement keeps all."""
    dim = candles.sparkSession.createDataFrame([(k, float(v)) for k, v in (windows or START_HOURS).items()], "duration int, window_hours double")
    tte = (F.unix_seconds(settle) - F.unix_seconds("ts")) / 3600
    return candles.join(F.broadcast(dim), "duration").where(tte.isNull() | (tte <= F.col("window_hours") + 1)).drop("window_hours")


def strip_warmup(candles: DataFrame, series: list[str] | None = None) -> DataFrame:
    """Without the candles before the first low above 0.1, nor the ceil(100 / duration), at least one, that follow it."""
    by = series or SERIES
    first = F.min(F.when(F.col("low") > 0.1, F.col("ts"))).over(Window.partitionBy(*by))
    real = candles.withColumn("__first", first).where("ts >= __first").drop("__first")
    skip = F.greatest(F.lit(1), F.ceil(F.lit(WARMUP_MINUTES) / F.col("duration")))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("ts"))
    return real.withColumn("__n", nth).where(F.col("__n") > skip).drop("__n")
