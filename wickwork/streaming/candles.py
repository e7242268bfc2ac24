"""Candles built and kept up to date on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.sources.candles import upsert_spot

#: Fixed value: how late a tick may come.
LATE = "30 minutes"


def stream_candles(ticks: DataFrame, duration: int, by: list[str], late: str = LATE) -> DataFrame:
    """Final candles from a stream of (ts, price, qty, seq); `duration` divides a day, so windows stand on the 17:30 local grid."""
    at = F.struct("ts", "seq")
    window = F.window("ts", f"{duration} minutes", startTime=f"{720 % duration} minutes")
    grouped = ticks.withWatermark("ts", late).groupBy(*by, window.alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("qty").alias("volume")
    )
    return grouped.select(*by, F.lit(duration).alias("duration"), F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def spot_upsert_sink(path: str):
    """A foreachBatch sink that merges spot bars by time; of a time that a batch has twice, the bar with the largest volume stays."""
    keys, values = ["spot", "duration", "ts"], ["open", "high", "low", "close"]

    def write(df: DataFrame, epoch: int) -> None:
        best = df.groupBy(*keys).agg(F.max(F.struct("volume", *values)).alias("v"))
        upsert_spot(best.select(*keys, *[f"v.{v}" for v in values], "v.volume"), path)

    return write


def enrich(stream: DataFrame, settlements: DataFrame, instruments: DataFrame) -> DataFrame:
    """Stream rows with settlement and product, from static tables."""
    rows = stream.join(settlements.select("spot", "expiry", "settle_ts"), ["spot", "expiry"], "left")
    return rows.join(instruments.select("spot", "expiry", "symbol", "product_id"), ["spot", "expiry", "symbol"], "left")


def live_only(stream: DataFrame) -> DataFrame:
    """Bars that open before their expiry settles (column settle_ts); a settled expiry leaves the live path."""
    return stream.where("settle_ts is null or ts < settle_ts")
