"""Stateful detection, indicators and outcome updates on streams of bars.

stream_red_squeeze keeps the open run of each series as Spark state;
detector_sink runs the detectors of the batch on each micro-batch and the bars
that open patterns still need. Both emit what is known when a pattern fires;
outcomes are open-ended and are brought up to date by their own sink. Bars of a
series must come in order of time, as stream_candles emits them.
"""

from __future__ import annotations

from collections.abc import Iterator

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wickwork.functions.candles import SERIES, is_green, is_red
from wickwork.functions.scalars import half_up
from wickwork.operators.asof import latest_spot, with_spot_bar
from wickwork.operators.detect import LOOKBACK, MIN_SEQ, RED_THRESHOLD, run_detectors
from wickwork.operators.filters import recent
from wickwork.operators.indicators import EMA_PERIODS, WINDOWS, last_points
from wickwork.sources.scratch import cut, remove
from wickwork.operators.outcomes import rounded_peak, with_peak_after
from wickwork.sources.candles import CANDLES
from wickwork.sources.tables import read_table, write_partitioned

FIRED = "spot string, expiry date, duration int, symbol string, entry_ts timestamp, entry_price double, pattern_start timestamp, seq_length int, ratio1 double, ratio2 double, signal_value double, trigger_high double"


def _end_at(state: GroupState, rows: pd.DataFrame) -> None:
    """The state of a series times out when the watermark passes the settle_ts of its rows, if they have one."""
    if "settle_ts" in rows.columns and pd.notna(settle := rows["settle_ts"].dropna().max()):
        # Spark hands over times of the session's zone, UTC, without a zone.
        at = settle.tz_localize("UTC") if settle.tzinfo is None else settle
        state.setTimeoutTimestamp(max(int(at.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))


def _squeeze(min_seq: int, min_value: float):
    """State: whether a bar was seen, and the open run's length, first and last body and start."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, n, first, last, start = state.get if state.exists else (False, 0, 0.0, 0.0, None)
        fired, rows = [], pd.concat(list(parts)).sort_values("ts")
        for bar in rows.itertuples():
            body = abs(bar.close - bar.open)
            if not seen:
                seen = True
            elif bar.close < bar.open:
                n, first, start = (n + 1, first, start) if n and body < last else (1, body, bar.ts)
                last = body
            else:
                if bar.close > bar.open and n >= min_seq and max(first / last, first / body) >= min_value:
                    value = max(first / last, first / body)
                    fired.append((*key, bar.ts, bar.close, start, n, *(math.floor(x * 1000.0 + 0.5) / 1000.0 for x in (first / last, first / body, value)), bar.high))
                n = 0
        state.update((seen, n, first, last, start))
        _end_at(state, rows)
        if fired:
            yield pd.DataFrame(fired, columns=[f.split()[0] for f in FIRED.split(", ")])

    return run


def stream_red_squeeze(bars: DataFrame, min_seq: int = MIN_SEQ, min_value: float = RED_THRESHOLD) -> DataFrame:
    """Red squeezes as they fire. With a watermark on ts and a column settle_ts a series' state goes when its expiry settles."""
    timeout = GroupStateTimeout.EventTimeTimeout if "settle_ts" in bars.columns else GroupStateTimeout.NoTimeout
    state = "seen boolean, n int, first double, last double, start timestamp"
    return bars.groupBy(*SERIES).applyInPandasWithState(_squeeze(min_seq, min_value), FIRED, state, "append", timeout)


def _indicators(periods: tuple, windows: tuple):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, values, highs, lows = state.get if state.exists else (0, [0.0] * len(periods), [], [])
        values, highs, lows, out = list(values), list(highs), list(lows), []
        rows = pd.concat(list(parts)).sort_values("ts")
        for bar in rows.itertuples():
            count += 1
            for i, p in enumerate(periods):
                # Up to the p-th bar the value is the running sum, whose mean seeds the recurrence.
                values[i] = values[i] + bar.close if count < p else (values[i] + bar.close) / p if count == p else bar.close * 2 / (p + 1) + values[i] * (1 - 2 / (p + 1))
            top, low = max(bar.open, bar.close), min(bar.open, bar.close)
            dist = lambda w: sum(abs(top - h) for h in highs[:w]) + sum(abs(low - x) for x in lows[:w])
            usable = bar.open > 0 and bar.close > 0
            vols = [dist(w) / (bar.open * bar.close) if usable and len(highs) >= w else None for w in windows]
            out.append((*key, bar.ts, bar.close, *[v if count >= p else None for v, p in zip(values, periods, strict=True)], *vols))
            highs, lows = [top, *highs][: max(windows)], [low, *lows][: max(windows)]
        state.update((count, values, highs, lows))
        _end_at(state, rows)
        yield pd.DataFrame(out, columns=[*SERIES, "ts", "close", *[f"ema{p}" for p in periods], *[f"vol{w}" for w in windows]])

    return run


def stream_indicators(bars: DataFrame, periods: tuple = EMA_PERIODS, windows: tuple = WINDOWS) -> DataFrame:
    """Moving averages and volatilities of each bar, from a state of the last averages and bodies.

    With a watermark on ts and a column settle_ts a series' state goes when its expiry settles.
    """
    timeout = GroupStateTimeout.EventTimeTimeout if "settle_ts" in bars.columns else GroupStateTimeout.NoTimeout
    out = "spot string, expiry date, duration int, symbol string, ts timestamp, close double" + "".join(f", ema{p} double" for p in periods) + "".join(f", vol{w} double" for w in windows)
    state = "count bigint, averages array<double>, highs array<double>, lows array<double>"
    return bars.groupBy(*SERIES).applyInPandasWithState(_indicators(periods, windows), out, state, "append", timeout)


def open_bars(bars: DataFrame) -> DataFrame:
    """The bars of each series that later patterns may need: an open run of red or of green bars with the bar before it, and those that a wall looks back on."""
    t, s = Window.partitionBy(*SERIES).orderBy("ts"), Window.partitionBy(*SERIES)
    rows = bars.withColumns({"__n": F.row_number().over(t), "__size": F.count("*").over(s)})
    last = lambda test: F.coalesce(F.max(F.when(~test, F.col("__n"))).over(s), F.lit(1))
    # A wall compares a bar with the one two before it, which looks at LOOKBACK bars; one more stands in for the first bar, which takes no part.
    least = F.least(F.col("__size") - (LOOKBACK + 3), last(is_red()), last(is_green()))
    return rows.withColumn("__least", least).where("__n >= __least").select(*bars.columns)


def firings(seen: DataFrame, spot: DataFrame, ids: list[str] | None = None, min_values: dict[str, float] | None = None) -> DataFrame:
    """Firings, with their outcomes, that the fresh bars of `seen` (with_open_bars) bring about.

    The detectors are those of the batch. Rising green bars fire when their run
    has ended, the other patterns at once. `spot` has the series of the bars'
    durations.
    """
    before = F.max(F.when(~F.col("fresh"), F.col("ts"))).alias("__before")
    edge = seen.groupBy(*SERIES).agg(F.max("ts").alias("__now"), before)
    found = run_detectors(with_spot_bar(with_peak_after(seen.drop("fresh")), spot), None, ids, min_values).drop("spot_bar").join(edge, SERIES)
    first = F.col("__before").isNull()
    ended = (F.col("signal") == "green_stairs") & (F.col("entry_ts") < F.col("__now")) & (first | (F.col("entry_ts") >= F.col("__before")))
    at_once = (F.col("signal") != "green_stairs") & (first | (F.col("entry_ts") > F.col("__before")))
    return found.where(ended | at_once).drop("__now", "__before")


def firing_sink(path: str, spot: DataFrame, ids: list[str] | None = None, min_values: dict[str, float] | None = None):
    """A foreachBatch sink of with_open_bars: firings of a batch go to `path`/epoch=n, so an epoch that is run again writes the same."""

    def write(seen: DataFrame, epoch: int) -> None:
        firings(cut(seen, "seen"), spot, ids, min_values).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def detector_sink(path: str, state: str, spot: DataFrame, ids: list[str] | None = None, min_values: dict[str, float] | None = None, settlements: DataFrame | None = None):
    """A foreachBatch sink for bars (the columns of CANDLES) without a watermark: firings go to `path`/epoch=n, the bars that stay open to `state`/epoch=n.

    Open bars are tables here, read and written in each epoch; with
    `settlements` (spot, expiry, settle_ts) those of chains that have settled by
    the newest bar of the batch are dropped. An epoch that is run again reads
    the one before it and writes the same. Of two bars of a time the new one
    counts.
    """
    names = [f.split()[0] for f in CANDLES.split(", ")]

    def write(new: DataFrame, epoch: int) -> None:
        spark = new.sparkSession
        kept = read_table(spark, f"{state}/epoch={epoch - 1}", CANDLES).select(*names)
        if settlements is not None:
            newest = F.broadcast(new.agg(F.max("ts").alias("__newest")))  # one row
            live = settlements.select("spot", "expiry", "settle_ts").join(newest, F.lit(True)).where("settle_ts > __newest or __newest is null")
            kept = kept.join(live.select("spot", "expiry"), ["spot", "expiry"], "left_semi")
        last = Window.partitionBy(*SERIES, "ts").orderBy(F.desc("fresh"), F.desc("volume"), *[F.desc(c) for c in names if c not in (*SERIES, "ts", "volume")])
        rows = kept.withColumn("fresh", F.lit(False)).unionByName(new.select(*names).withColumn("fresh", F.lit(True)))
        both = cut(rows.withColumn("__k", F.row_number().over(last)).where("__k = 1").drop("__k"), "stream")
        firings(both, spot, ids, min_values).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        # Series without a new bar stay as they are. An epoch that is run again reads the one before it, nothing older.
        remove(spark, f"{state}/epoch={epoch - 2}")
        open_bars(both.drop("fresh")).write.mode("overwrite").parquet(f"{state}/epoch={epoch}")

    return write


def update_outcomes(open_signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Signals with peak_after, state, broke_out and ratio brought up to date by bars later than their entry.

    A pending signal without a later bar stays pending, whatever its peak_after.
    """
    later = bars.select(*SERIES, F.col("ts").alias("__t"), F.col("high").alias("__h"))
    keys = [*SERIES, "entry_ts"]
    peaks = open_signals.select(*keys).distinct().join(later, SERIES).where("__t > entry_ts").groupBy(*keys).agg(F.max("__h").alias("__peak"))
    return with_peaks(open_signals, peaks)


def with_peaks(open_signals: DataFrame, peaks: DataFrame) -> DataFrame:
    """Signals brought up to date by the highest later bar of each (SERIES, entry_ts, __peak), if any."""
    rows = open_signals.join(peaks, [*SERIES, "entry_ts"], "left")
    pending, peak, trigger = (F.col("state") == "pending"), F.col("__peak"), F.col("trigger_high")
    up = (F.col("state") == "activated") | F.coalesce(peak > trigger, F.lit(False))
    ratio = F.when(trigger > 0, half_up(F.try_divide(peak, trigger), 3)).otherwise(0.0)
    new = {
        "state": F.when(up, "activated").when(pending & peak.isNull(), "pending").otherwise("slHit"),
        "ratio": F.when(peak.isNull(), F.col("ratio")).when(pending, ratio).otherwise(F.greatest("ratio", ratio)),
        "peak_after": F.when(peak.isNull(), F.col("peak_after")).when(pending, rounded_peak(peak)).otherwise(F.greatest("peak_after", rounded_peak(peak))),
    }
    if "broke_out" in open_signals.columns:
        new["broke_out"] = up
    return rows.withColumns(new).select(*open_signals.columns)


def outcome_sink(path: str, schema: str):
    """A foreachBatch sink: bars of a batch update the stored signals of their chains."""

    def write(bars: DataFrame, epoch: int) -> None:
        stored = read_table(bars.sparkSession, path, schema).join(bars.select("spot", "expiry").distinct(), ["spot", "expiry"], "left_semi")
        write_partitioned(cut(update_outcomes(stored, bars), "outcomes"), path, ["spot", "expiry"])

    return write


def live_signals(signals: DataFrame, now, limit: int = 500) -> DataFrame:
    """The newest signals of the last 48 hours."""
    return recent(signals, now).orderBy(F.desc("entry_ts"), "symbol", "duration", "signal").limit(limit)


def snapshot_sink(path: str, points: int = 240):
    """A foreachBatch sink of indicator rows: the newest points of each series replace those of its chain."""
    return lambda df, epoch: write_partitioned(last_points(df, points), path, ["spot", "expiry"])


def live_snapshot(bars: DataFrame, signals: DataFrame, spot: DataFrame, settlements: DataFrame, now, limit: int = 500) -> DataFrame:
    """One row per chain: hours_to_expiry (1 place), spot_price, durations, instruments, how many signals fired in the last 48 hours, and the newest `limit` of them.

    The averages and volatilities of a snapshot are tables of their own
    (snapshot_sink and volatility_board), joined by spot and expiry.
    """
    chain = bars.groupBy("spot", "expiry").agg(F.count_distinct("symbol").alias("instruments"), F.sort_array(F.collect_set("duration")).alias("durations"))
    fresh = recent(signals, now)
    order = Window.partitionBy("spot", "expiry").orderBy(F.desc("entry_ts"), "symbol", "duration", "signal")
    ranked = fresh.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= limit)
    row = F.struct("__k", "signal", "duration", "symbol", "entry_ts", "entry_price", "signal_value", "state", "ratio")
    # Each chain holds `limit` signals at most.
    board = ranked.groupBy("spot", "expiry").agg(F.sort_array(F.collect_list(row)).alias("signals"))
    count = fresh.groupBy("spot", "expiry").agg(F.count("*").alias("n_signals"))
    out = chain.join(settlements.select("spot", "expiry", "settle_ts"), ["spot", "expiry"], "left").join(count, ["spot", "expiry"], "left").join(board, ["spot", "expiry"], "left")
    out = out.join(latest_spot(spot).withColumnRenamed("close", "spot_price"), "spot", "left")
    hours = half_up((F.unix_seconds("settle_ts") - F.unix_seconds(now)) / 3600, 1)
    return out.withColumns({"hours_to_expiry": hours, "n_signals": F.coalesce("n_signals", F.lit(0))})
