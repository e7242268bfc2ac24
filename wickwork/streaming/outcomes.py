"""Outcomes of open signals by a join of two streams, and a pass that publishes its tables together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickwork.functions.candles import SERIES
from wickwork.operators.indicators import last_points
from wickwork.sources.scratch import cut, folder, remove
from wickwork.sources.tables import read_table
from wickwork.streaming.signals import firings, with_peaks

#: How late a row may come, and for how long after its entry a signal is followed.
LATE, FOLLOWED = "6 hours", "40 days"
PEAK = "spot string, expiry date, duration int, symbol string, entry_ts timestamp, peak double"


def later_bars(signals: DataFrame, bars: DataFrame, late: str = LATE, followed: str = FOLLOWED) -> DataFrame:
    """(SERIES, entry_ts, ts, high): each bar after each open signal of its series, from two streams.

    Both sides wait for each other in state: a bar until no signal from before
    it can still come, a signal for the time it is followed. Equal signals of a
    series and moment are one.
    """
    left = signals.select(*SERIES, "entry_ts").withWatermark("entry_ts", late).dropDuplicatesWithinWatermark([*SERIES, "entry_ts"])
    right = bars.select(*[F.col(c).alias(f"__{c}") for c in SERIES], "ts", "high").withWatermark("ts", late)
    same = F.lit(True)
    for c in SERIES:
        same = same & (F.col(c) == F.col(f"__{c}"))
    inside = (F.col("ts") > F.col("entry_ts")) & (F.col("ts") <= F.col("entry_ts") + F.expr(f"interval {followed}"))
    return left.join(right, same & inside).select(*SERIES, "entry_ts", "ts", "high")


def peak_sink(path: str):
    """A foreachBatch sink of later_bars: the highest bar of each signal in the batch goes to `path`/epoch=n; nothing written before is touched."""

    def write(rows: DataFrame, epoch: int) -> None:
        rows.groupBy(*SERIES, "entry_ts").agg(F.max("high").alias("peak")).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def followed_outcomes(signals: DataFrame, path: str) -> DataFrame:
    """Signals with the outcomes that the peaks of all epochs give them."""
    peaks = read_table(signals.sparkSession, path, PEAK).groupBy(*SERIES, "entry_ts").agg(F.max("peak").alias("__peak"))
    return with_peaks(signals, peaks)


#: Tables of a pass.
PASS = ("signals", "board", "points")


def _stamp(spark: SparkSession, path: str, epoch: int):
    return folder(spark, f"{path}/published/epoch={epoch}")


def published(spark: SparkSession, path: str) -> list[int]:
    """The epochs whose tables can be read, in order: one marker file each."""
    fs, at = folder(spark, f"{path}/published")
    return sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(at) if "=" in f.getPath().getName()) if fs.exists(at) else []


def read_pass(spark: SparkSession, path: str, name: str, schema) -> DataFrame:
    """A table as the last published pass left it: all signals, or the newest board or points."""
    epochs = published(spark, path)
    if not epochs:
        return spark.createDataFrame([], schema)
    wanted = epochs if name == "signals" else epochs[-1:]
    return spark.read.schema(schema).parquet(*[f"{path}/{name}/epoch={e}" for e in wanted])


def live_pass_sink(path: str, spot: DataFrame, settlements: DataFrame, ids: list[str] | None = None, min_values: dict[str, float] | None = None, points: int = 240):
    """A foreachBatch sink of with_open_bars that writes three tables a pass and publishes them at once.

    signals: what fires in the pass. points: the newest `points` bars of each
    series that has not settled by the pass's newest bar. board: one row per
    chain of those, with its symbols and all its signals so far. Each table
    goes to a folder of the epoch; when all are complete one marker appears, and
    readers see nothing of a pass without it. A pass that is run again, with or
    without marker, writes the same rows from the last pass published before it.
    """

    def write(seen: DataFrame, epoch: int) -> None:
        spark = seen.sparkSession
        before = [e for e in published(spark, path) if e < epoch]
        seen = cut(seen, "seen")
        found = firings(seen, spot, ids, min_values)
        found.write.mode("overwrite").parquet(f"{path}/signals/epoch={epoch}")
        kept = seen.drop("fresh")
        if before:
            old = spark.read.schema(kept.schema).parquet(f"{path}/points/epoch={before[-1]}")
            kept = old.join(seen.select(*SERIES, "ts"), [*SERIES, "ts"], "left_anti").unionByName(kept)
        newest = F.broadcast(kept.agg(F.max("ts").alias("__newest")))  # one row
        live = kept.join(settlements.select("spot", "expiry", "settle_ts"), ["spot", "expiry"], "left").join(newest, F.lit(True)).where("settle_ts is null or settle_ts > __newest")
        last_points(live.drop("settle_ts", "__newest"), points).write.mode("overwrite").parquet(f"{path}/points/epoch={epoch}")
        shown = spark.read.schema(kept.schema).parquet(f"{path}/points/epoch={epoch}")
        fired = spark.read.schema(found.schema).parquet(*[f"{path}/signals/epoch={e}" for e in [*before, epoch]])
        count = fired.groupBy("spot", "expiry").agg(F.count("*").alias("n_signals"), F.max("entry_ts").alias("last_signal"))
        board = shown.groupBy("spot", "expiry").agg(F.count_distinct("symbol").alias("instruments"), F.max("ts").alias("last_bar")).join(count, ["spot", "expiry"], "left")
        board.withColumn("n_signals", F.coalesce("n_signals", F.lit(0))).write.mode("overwrite").parquet(f"{path}/board/epoch={epoch}")
        fs, at = _stamp(spark, path, epoch)
        fs.mkdirs(at.getParent())
        fs.create(at, True).close()
        # A pass that is run again reads the one before it, nothing older.
        for old in before[:-1]:
            remove(spark, f"{path}/board/epoch={old}")
            remove(spark, f"{path}/points/epoch={old}")

    return write

