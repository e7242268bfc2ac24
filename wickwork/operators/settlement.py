"""Settlement times, hours to expiry and what depends on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickwork.operators.rollup import START_HOURS
from wickwork.operators.stab import stab_join

#: Fixed value: time of day, in UTC seconds, at which an expiry settles unless something else is known.
DEFAULT_SETTLE_SECONDS, LISTED_DAYS = 12 * 3600, 40


def at_seconds(expiry: Column | str, seconds: Column | int) -> Column:
    """The expiry's date at a time of day in UTC seconds."""
    days = F.datediff(F.col(expiry) if isinstance(expiry, str) else expiry, F.lit("1970-01-01").cast("date"))
    return F.timestamp_seconds(days.cast("bigint") * 86_400 + seconds)


def with_settlement(df: DataFrame, learned: DataFrame, learned_spot: DataFrame, defaults: DataFrame) -> DataFrame:
    """settle_ts: learned for the expiry, else learned for the spot, else the spot's default, else the global one.

    learned (spot, expiry, settle_seconds); learned_spot and defaults (spot, settle_seconds).
    """
    a = learned.select("spot", "expiry", F.col("settle_seconds").alias("__a"))
    b = learned_spot.select("spot", F.col("settle_seconds").alias("__b"))
    c = defaults.select("spot", F.col("settle_seconds").alias("__c"))
    rows = df.join(a, ["spot", "expiry"], "left").join(b, "spot", "left").join(c, "spot", "left")
    return rows.withColumn("settle_ts", at_seconds("expiry", F.coalesce("__a", "__b", "__c", F.lit(DEFAULT_SETTLE_SECONDS)))).drop("__a", "__b", "__c")


def tte_hours(at: Column | str, settle: Column | str = "settle_ts") -> Column:
    return (F.unix_seconds(settle) - F.unix_seconds(at)) / 3600


def with_tte(df: DataFrame, now: Column) -> DataFrame:
    """Hours to expiry at `now`, settled (settlement before now) and live."""
    settled = F.col("settle_ts") < now
    return df.withColumns({"tte_hours": tte_hours(now), "settled": settled, "live": ~settled})


def active_durations(expiries: DataFrame, now: Column, windows: dict[int, float] | None = None) -> DataFrame:
    """(expiry columns, duration) where hours to expiry are below the duration's window plus one."""
    dim = expiries.sparkSession.createDataFrame([(k, float(v)) for k, v in (windows or START_HOURS).items()], "duration int, window_hours double")
    return expiries.crossJoin(F.broadcast(dim)).where(tte_hours(now) < F.col("window_hours") + 1).drop("window_hours")


def listed_expiries(expiries: DataFrame, candles: DataFrame) -> DataFrame:
    """Expiries with listed_ts: the first candle of the coarsest duration, else 40 days before settlement."""
    coarsest = candles.groupBy("spot", "expiry").agg(F.min(F.struct((-F.col("duration")).alias("d"), F.col("ts"))).alias("f")).select("spot", "expiry", F.col("f.ts").alias("__first"))
    listed = F.coalesce("__first", F.timestamp_seconds(F.unix_seconds("settle_ts") - LISTED_DAYS * 86_400))
    return expiries.join(coarsest, ["spot", "expiry"], "left").withColumn("listed_ts", listed).drop("__first")


def alive_expiries(expiries: DataFrame, candles: DataFrame, at: Column) -> DataFrame:
    """Expiries listed by `at` and not yet settled."""
    return listed_expiries(expiries, candles).where((F.col("listed_ts") <= at) & (F.col("settle_ts") > at))


def alive_at(expiries: DataFrame, candles: DataFrame, moments: DataFrame) -> DataFrame:
    """The same for each moment of a table (column at), in one join."""
    return stab_join(listed_expiries(expiries, candles), moments.select("at").distinct(), "listed_ts", "settle_ts")
