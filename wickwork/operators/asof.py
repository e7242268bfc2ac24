"""As-of join of time series, and the choice of a spot series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickwork.functions.candles import SERIES
from wickwork.operators.rollup import grouped_candles


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], take: list[str], right_on: str | None = None, bucket_days: int | None = None) -> DataFrame:
    """`left` with the `take` columns of the last `right` row of the same `by` at or before `on`; null before the first.

    Both sides meet in one shuffle by `by`. For few and very long series give
    `bucket_days`: rows are then partitioned by day bucket too, and each bucket
    starts from the last row of the buckets before it. Of several `right` rows
    of one time the one with the largest `take` counts.
    """
    right_on = right_on or on
    payload = F.struct(*[F.col(c).alias(c) for c in take])
    r = right.select(*by, F.col(right_on).alias("__t"), F.lit(0).alias("__side"), payload.alias("__r"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType).alias("__l"))
    l = left.select(*by, F.col(on).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), F.struct(*left.columns).alias("__l"))
    both, keys = r.unionByName(l), list(by)
    carried = None
    if bucket_days:
        bucket = F.floor(F.unix_seconds("__t") / (86_400 * bucket_days))
        both, keys = both.withColumn("__b", bucket), [*by, "__b"]
        # One row per series and bucket: the last value of each bucket, carried forward.
        last = both.groupBy(*keys).agg(F.max(F.when(F.col("__side") == 0, F.struct("__t", "__r"))).alias("__own"))
        earlier = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        carried = last.select(*keys, F.last("__own.__r", ignorenulls=True).over(earlier).alias("__carry"))
    w = Window.partitionBy(*keys).orderBy("__t", "__side", "__r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    if carried is not None:
        seen = seen.join(carried, keys, "left").withColumn("__r", F.coalesce("__r", "__carry"))
    return seen.select("__l.*", *[F.col(f"__r.`{c}`").alias(c) for c in take])


#: A bar looks at the spot series of its own duration. The days of a series are joined apart from each other.
PER, DAYS = ("spot", "duration"), 1


def with_spot(df: DataFrame, spot: DataFrame, on: str = "ts", name: str = "spot_close", closed_only: bool = False, per: tuple[str, ...] = PER, days: int = DAYS) -> DataFrame:
    """The spot close in force at `on`, in the spot series of the same duration.

    Bars carry their opening time, so the bar in force may close later;
    closed_only takes ended bars alone. `per` without the duration is for a
    spot of a single series.
    """
    bars = spot.select(*per, F.col("ts").alias("__at"), F.col("close").alias(name), *(["duration"] if closed_only and "duration" not in per else []))
    if closed_only:
        bars = bars.withColumn("__at", F.timestamp_seconds(F.unix_seconds("__at") + F.col("duration") * 60))
    return asof_join(df, bars, on, list(per), [name], "__at", days)


def with_spot_bar(df: DataFrame, spot: DataFrame, on: str = "ts", days: int = DAYS) -> DataFrame:
    """spot_bar (open, high, low, close) in force at `on`, and spot_close, its close."""
    bars = spot.select(*PER, F.col("ts").alias("__at"), F.struct("open", "high", "low", "close").alias("spot_bar"))
    return asof_join(df, bars, on, list(PER), ["spot_bar"], "__at", days).withColumn("spot_close", F.col("spot_bar.close"))


def spot_for_duration(spot: DataFrame, durations: list[int], preferred: tuple[int, ...] = (5, 15, 30, 60)) -> DataFrame:
    """Spot candles of each duration from the preferred base that divides it, else the largest stored divisor."""
    spark = spot.sparkSession
    want = spark.createDataFrame([(d,) for d in durations], "to int")
    stored = spot.select("spot", "duration").distinct()
    pick = Window.partitionBy("spot", "to").orderBy(F.col("duration").isin(*preferred).desc(), F.desc("duration"))
    base = stored.crossJoin(F.broadcast(want)).where("to % duration = 0").withColumn("n", F.row_number().over(pick)).where("n = 1")
    plan = base.select("spot", "duration", "to")
    # Every bar goes once to each duration that it feeds, and all durations are grouped in one pass.
    return grouped_candles(spot.join(plan, ["spot", "duration"]), ["spot"])


def latest_spot(spot: DataFrame, among: tuple[int, ...] = (5, 15, 30, 60)) -> DataFrame:
    """(spot, close): the newest close of the finest series that a spot has."""
    usable = spot.where(F.col("duration").isin(*among))
    return usable.groupBy("spot").agg(F.max_by("close", F.struct(-F.col("duration"), F.col("ts"))).alias("close"))


def require_spot(df: DataFrame, spot: DataFrame) -> DataFrame:
    """Rows whose spot has any candle."""
    return df.join(spot.select("spot").distinct(), "spot", "left_semi")


__all__ = ["SERIES", "asof_join", "latest_spot", "require_spot", "spot_for_duration", "with_spot", "with_spot_bar"]
