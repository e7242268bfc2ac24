"""Moneyness of merged events, and the tags that reports group by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.functions.bands import MONEYNESS_BUCKETS, TTE_BUCKETS, bucket_first
from wickwork.functions.candles import signed_distance, with_instrument_cols
from wickwork.operators.asof import with_spot
from wickwork.operators.settlement import tte_hours

IDENTITY = ["signal", "spot", "expiry", "duration", "type", "start_ts"]


def event_moneyness(events: DataFrame, spot: DataFrame) -> DataFrame:
    """moneyness: signed distance in percent of univ_symbol's strike, else the mean over the firing instruments; null without spot at the start."""
    symbols = F.when(F.col("univ_symbol").isNotNull(), F.array("univ_symbol")).otherwise(F.col("instruments"))
    each = with_spot(events.select(*IDENTITY, F.explode(symbols).alias("symbol")), spot, "start_ts")
    each = with_instrument_cols(each).where("opt_type is not null and strike is not null")
    mean = each.groupBy(*IDENTITY).agg(F.avg(signed_distance(F.col("opt_type"), F.col("strike"), F.col("spot_close"))).alias("moneyness"))
    return events.join(mean, IDENTITY, "left")


def tag_events(events: DataFrame, spot: DataFrame) -> DataFrame:
    """tte_hours (column settle_ts needed), moneyness and the buckets of both; rows without moneyness keep a null bucket."""
    rows = event_moneyness(events, spot).withColumn("tte_hours", tte_hours("start_ts"))
    return rows.withColumns({"tte": bucket_first(F.col("tte_hours"), TTE_BUCKETS), "moneyness_bucket": bucket_first(F.col("moneyness"), MONEYNESS_BUCKETS)})


def tagged_and_excluded(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with moneyness, one row with the number of those without)."""
    return tagged.where("moneyness_bucket is not null"), tagged.agg(F.count_if(F.col("moneyness_bucket").isNull()).alias("excluded"))
