"""Candles from pages and compact arrays, and the candle tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wickwork.functions.candles import SERIES
from wickwork.sources.tables import read_table, replace_where, write_partitioned

PAGE = "symbol string, resolution string, result array<struct<time bigint, open string, high string, low string, close string, volume string>>"
CANDLES = "spot string, expiry date, duration int, symbol string, ts timestamp, open double, high double, low double, close double, volume double"
SPOT = "spot string, duration int, dt date, ts timestamp, open double, high double, low double, close double, volume double"
VALUES = ["open", "high", "low", "close", "volume"]
#: Names of the resolutions that pages use.
RESOLUTIONS = {"5m": 5, "15m": 15, "30m": 30, "1h": 60, "2h": 120, "4h": 240, "6h": 360, "12h": 720, "1d": 1440}


def read_candle_pages(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, duration, ts, values) from JSON pages with prices as text; one row per candle, of several the one with the largest volume, then the largest prices."""
    minutes = F.create_map(*[F.lit(x) for kv in RESOLUTIONS.items() for x in kv])
    rows = spark.read.schema(PAGE).json(path).select("symbol", minutes[F.col("resolution")].alias("duration"), F.explode("result").alias("c"))
    out = rows.select("symbol", "duration", F.timestamp_seconds("c.time").alias("ts"), *[F.col(f"c.{v}").try_cast("double").alias(v) for v in VALUES])
    best = F.max(F.struct("volume", *VALUES[:-1])).alias("v")
    return out.groupBy("symbol", "duration", "ts").agg(best).select("symbol", "duration", "ts", *[f"v.{v}" for v in VALUES])


def read_compact_candles(spark: SparkSession, path: str) -> DataFrame:
    """Candles from files {spot}/{expiry}/{duration}/{symbol}.json of arrays [time, open, high, low, close, volume]."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("p"))
    return compact_rows(text)


def compact_rows(text: DataFrame) -> DataFrame:
    """Candles from (p, value): the path that names a series and its array of arrays."""
    part = lambda i: F.regexp_extract("p", r"([^/]+)/(\d{4}-\d\d-\d\d)/(\d+)/([^/]+)\.json$", i)
    rows = text.select(part(1).alias("spot"), part(2).cast("date").alias("expiry"), part(3).cast("int").alias("duration"), part(4).alias("symbol"), F.explode(F.from_json("value", "array<array<double>>")).alias("c"))
    named = [F.get("c", F.lit(i + 1)).alias(v) for i, v in enumerate(VALUES)]
    return rows.select(*SERIES, F.timestamp_seconds(F.get("c", F.lit(0)).cast("bigint")).alias("ts"), *named)


def write_candles(df: DataFrame, path: str) -> None:
    write_partitioned(df, path, ["spot", "expiry", "duration"])


def write_clustered(candles: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Candles as a table bucketed by series and sorted by time: windows and groups over a series read it without an exchange."""
    rows = candles.repartition(buckets, *SERIES)
    rows.write.mode("overwrite").bucketBy(buckets, *SERIES).sortBy(*SERIES, "ts").option("path", path).saveAsTable(table)
    return candles.sparkSession.table(table)


def read_candles(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, CANDLES)


def newest_bars(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Spot bars of both; at one time of one series the new bar stays."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy("spot", "duration", "ts").orderBy(F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__new")


def upsert_spot(new: DataFrame, path: str) -> None:
    """Merge bars into the spot table by time; days without new bars are not touched."""
    replace_where(new.withColumn("dt", F.to_date("ts")), path, ["spot", "duration", "ts"], ["spot", "duration", "dt"], SPOT)


def read_spot(spark: SparkSession, path: str, spot: str, duration: int, low: str, high: str) -> DataFrame:
    """Spot bars of a closed range of days; all conditions prune partitions."""
    days = F.col("dt").between(F.lit(low).cast("date"), F.lit(high).cast("date"))
    return read_table(spark, path, SPOT).where((F.col("spot") == spot) & (F.col("duration") == duration) & days)
