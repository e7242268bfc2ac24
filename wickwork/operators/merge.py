"""Overlapping firings, pattern rows and trades merged into events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickwork.functions.candles import with_instrument_cols

EVENT_KEYS = ["signal", "spot", "expiry", "duration", "type"]


def islands(df: DataFrame, keys: list[str], start: str, end: str, name: str = "island") -> DataFrame:
    """Numbers the groups of overlapping closed ranges [start, end] within `keys`."""
    w = Window.partitionBy(*keys).orderBy(start, end, "symbol")
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    return df.withColumn("__opens", opens).withColumn(name, F.sum("__opens").over(w)).drop("__opens")


def _state(state: Column) -> Column:
    """Activated before pending before slHit."""
    rank = F.max(F.when(state == "activated", 2).when(state == "pending", 1).otherwise(0))
    return F.when(rank == 2, "activated").when(rank == 1, "pending").otherwise("slHit")


def merge_events(signals: DataFrame) -> DataFrame:
    """Firings of one type whose ranges (pattern start to entry) overlap, as one event.

    Counts add up; the largest value, ratio and universe ratio stay, the last
    with its own symbol (the smallest one of equals); `instruments` keeps
    duplicates, sorted.
    """
    rows = with_instrument_cols(signals).where("opt_type is not null").withColumnRenamed("opt_type", "type")
    rows = islands(rows, EVENT_KEYS, "pattern_start", "entry_ts")
    best = F.min(F.struct((-F.coalesce("univ_ratio", F.lit(0.0))).alias("r"), F.coalesce("univ_symbol", F.lit("~")).alias("s")))
    merged = rows.groupBy(*EVENT_KEYS, "island").agg(
        F.min("pattern_start").alias("start_ts"), F.max("entry_ts").alias("end_ts"), F.count("*").cast("int").alias("n"),
        F.max("signal_value").alias("max_value"), F.max("ratio").alias("max_ratio"), _state(F.col("state")).alias("state"),
        F.sort_array(F.collect_list("symbol")).alias("instruments"), best.alias("__b"),
    )
    named = merged.withColumns({"univ_ratio": -F.col("__b.r") + F.lit(0.0), "univ_symbol": F.when((F.col("__b.s") != "~") & (F.col("__b.r") < 0), F.col("__b.s"))})
    return named.drop("__b", "island")


def as_units(rows: DataFrame) -> DataFrame:
    """Single pattern rows in the shape of merged ones."""
    return rows.withColumns({"n": F.lit(1), "instruments": F.array("symbol"), "start_ts": F.col("pattern_start"), "end_ts": F.col("entry_ts")})


def merge_rows(rows: DataFrame, fold: str | None = None) -> DataFrame:
    """Filtered pattern rows merged per (expiry, duration, type) where they overlap.

    The row of the best ratio names the unit; symbols are distinct; the fold
    side (a column, if given) is that of the first member by (start, symbol);
    a unit wins if any member does (column `win`).
    """
    keys = ["spot", "expiry", "duration", "type"]
    rows = islands(rows, keys, "pattern_start", "entry_ts")
    top = F.struct(F.col("ratio"), (-F.unix_seconds("pattern_start")).alias("t"), F.col("symbol"))
    first = F.struct("pattern_start", "symbol")
    made = [
        F.count("*").cast("int").alias("n"), F.min("pattern_start").alias("start_ts"), F.max("entry_ts").alias("end_ts"), F.max_by("symbol", top).alias("symbol"),
        F.max("signal_value").alias("signal_value"), F.max("ratio").alias("ratio"), F.max("univ_ratio").alias("univ_ratio"), F.bool_or("win").alias("win"),
        F.sort_array(F.collect_set("symbol")).alias("instruments"), F.min_by("pattern_start", first).alias("pattern_start"), F.max_by("entry_ts", top).alias("entry_ts"),
    ]
    if fold:
        made.append(F.min_by(fold, first).alias(fold))
    return rows.groupBy(*keys, "island").agg(*made).drop("island")


def _sweep(cap_candles: int):
    """Merges the trades of one group in order of their starts; the cap makes the outcome depend on that order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["low_ts", "symbol", "high_ts"], kind="stable").reset_index(drop=True)
        cap = pd.Timedelta(minutes=cap_candles * int(pdf["duration"].iloc[0]))
        event, ends, at = [], None, -1
        for low, high in zip(pdf["low_ts"], pdf["high_ts"], strict=True):
            if ends is not None and low <= ends and max(ends, high) - ends <= cap:
                ends = max(ends, high)
            else:
                at, ends = at + 1, high
            event.append(at)
        return pdf.assign(event=event)

    return run


def merge_trades(trades: DataFrame, cap: int = 30) -> DataFrame:
    """Trades merged into events: a trade joins the last event if it overlaps it and stretches its end by `cap` candles at most.

    Where no earlier trade of a chain and type reaches over, no event does, so
    the order is swept island by island: a group is an island of overlapping
    trades, however long its chain.
    """
    keys = ["spot", "expiry", "duration", "type", "island"]
    cutting = islands(trades, keys[:-1], "low_ts", "high_ts")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cutting.schema)
    swept = cutting.groupBy(*keys).applyInPandas(_sweep(cap), f"{kinds}, event int")
    member = F.struct((-F.col("ratio")).alias("__r"), F.col("low_ts").alias("__t"), F.col("symbol"), F.col("high_ts"))
    best = F.struct(F.col("ratio"), (-F.unix_seconds("low_ts")).alias("t"), F.col("symbol"))
    merged = swept.groupBy(*keys, "event").agg(
        F.min("low_ts").alias("start_ts"), F.max("high_ts").alias("end_ts"), F.count("*").cast("int").alias("n"), F.max("ratio").alias("max_ratio"),
        F.max_by("symbol", best).alias("max_symbol"), F.max_by("low_price", best).alias("max_low"), F.max_by("high_price", best).alias("max_high"),
        F.floor(F.avg("hold_candles") + 0.5).cast("int").alias("hold_candles"), F.sort_array(F.collect_list(member)).alias("__m"),
    )
    tidy = F.transform("__m", lambda x: F.struct(x["symbol"].alias("symbol"), (-x["__r"]).alias("ratio"), x["__t"].alias("low_ts"), x["high_ts"].alias("high_ts")))
    return merged.withColumn("instruments", tidy).drop("__m", "event", "island")
