"""Events, pattern rows, trades and live snapshots as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickwork.sources.tables import read_table, write_partitioned, write_scope

EVENTS = (
    "signal string, spot string, expiry date, duration int, type string, start_ts timestamp, end_ts timestamp, n int, max_value double, "
    "max_ratio double, state string, instruments array<string>, univ_ratio double, univ_symbol string"
)
TRADE_EVENTS = (
    "spot string, expiry date, duration int, type string, start_ts timestamp, end_ts timestamp, n int, max_ratio double, max_symbol string, max_low double, "
    "max_high double, hold_candles int, instruments array<struct<symbol string, ratio double, low_ts timestamp, high_ts timestamp>>"
)


def write_events(df: DataFrame, path: str, signal: str, spot: str, expiry: str) -> None:
    """Make `df` all events of one signal and expiry; running it again, or with no rows, leaves what this run found."""
    write_scope(df, path, {"signal": signal, "spot": spot, "expiry": expiry}, ["signal", "spot", "expiry", "duration"])


def write_all_events(df: DataFrame, path: str) -> None:
    """Replace every scope that `df` has events of, in one job; scopes without a row stay as they are."""
    write_partitioned(df, path, ["signal", "spot", "expiry", "duration"])


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, EVENTS).withColumn("univ_ratio", F.coalesce("univ_ratio", F.lit(0.0)))


def write_patterns(df: DataFrame, path: str) -> None:
    write_partitioned(df, path, ["signal", "spot", "duration", "expiry"])


def read_patterns(spark: SparkSession, path: str, schema, signal: str | None = None, spot: str | None = None) -> DataFrame:
    rows = read_table(spark, path, schema)
    rows = rows.where(F.col("signal") == signal) if signal else rows
    return rows.where(F.col("spot") == spot) if spot else rows


def write_trades(df: DataFrame, path: str) -> None:
    write_partitioned(df, path, ["spot", "expiry", "duration"])


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, TRADE_EVENTS)


def write_best_trades(df: DataFrame, path: str) -> None:
    write_partitioned(df, path, ["spot", "expiry"])


def read_best_trades(spark: SparkSession, path: str, schema) -> DataFrame:
    return read_table(spark, path, schema)


def write_snapshot(path: str):
    """A foreachBatch sink: each pass replaces the stored rows of the (spot, expiry) pairs it has."""
    return lambda df, epoch: write_partitioned(df, path, ["spot", "expiry"])


def prune_settled(df: DataFrame, settlements: DataFrame, now) -> DataFrame:
    """Rows of expiries that have not settled by `now`; those without a known settlement stay."""
    rows = df.join(settlements.select("spot", "expiry", "settle_ts"), ["spot", "expiry"], "left")
    return rows.where(F.col("settle_ts").isNull() | (F.col("settle_ts") >= now)).drop("settle_ts")
