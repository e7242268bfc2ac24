"""Bars that open patterns need, as keyed state that ends when a series settles.

One processor serves all detectors: for each series with new bars it gives
these and the bars before them that a pattern can still reach, and keeps what
later patterns will need. An event-time timer at the settlement clears a series;
what comes later finds no state and is left out by live_only before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wickwork.functions.candles import SERIES
from wickwork.operators.detect import LOOKBACK
from wickwork.sources.candles import VALUES

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BAR = "ts timestamp, " + ", ".join(f"{v} double" for v in VALUES)
SEEN = "spot string, expiry date, duration int, symbol string, " + BAR + ", fresh boolean"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which processors with timers need; the setting is put back."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def first_needed(opens: np.ndarray, closes: np.ndarray) -> int:
    """Place of the first bar of a series that later patterns may reach: before an open run of red or of green bars, or as far back as a wall looks."""

    def last(test: np.ndarray) -> int:
        return int(np.flatnonzero(test)[-1]) if test.any() else 0

    # A wall compares a bar with the one two before it, which looks at LOOKBACK bars; one more stands in for the first bar of a series.
    return max(0, min(len(opens) - (LOOKBACK + 4), last(~(closes < opens)), last(~(closes > opens))))


class OpenBars(StatefulProcessor):
    """List state of a series' open bars, and the timer of its settlement."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getListState("bars", BAR)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("ts", kind="stable")
        settle = new["settle_ts"].dropna().max() if "settle_ts" in new else pd.NaT
        names = ["ts", *VALUES]
        old = pd.DataFrame(list(self.bars.get()) if self.bars.exists() else [], columns=names)
        if old.empty and pd.notna(settle):
            at = pd.Timestamp(settle).tz_localize(timezone.utc) if pd.Timestamp(settle).tzinfo is None else pd.Timestamp(settle)
            self.handle.registerTimer(max(int(at.timestamp() * 1000), timerValues.getCurrentWatermarkInMs() + 1))
        parts = [part.assign(fresh=fresh) for part, fresh in ((old, False), (new[names], True)) if len(part)]
        # Of two bars of one time the one that came last counts.
        both = pd.concat(parts).drop_duplicates("ts", keep="last").sort_values("ts", kind="stable").reset_index(drop=True)
        kept = both.iloc[first_needed(both["open"].to_numpy(float), both["close"].to_numpy(float)) :]
        self.bars.put([(r.ts.to_pydatetime(), *(float(getattr(r, v)) for v in VALUES)) for r in kept.itertuples()])
        yield both.assign(**dict(zip(SERIES, key, strict=True)))[[*SERIES, *names, "fresh"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.bars.clear()
        yield pd.DataFrame(columns=[*SERIES, "ts", *VALUES, "fresh"])

    def close(self) -> None:
        pass


def with_open_bars(bars: DataFrame) -> DataFrame:
    """Of each series with new bars: its open bars (fresh false) and the new ones (fresh true).

    `bars` is a stream with a watermark on ts, the columns of CANDLES and
    settle_ts, in order of time within a series. State is as long as the open
    runs, and goes when the watermark passes settle_ts; a series without
    settle_ts stays. Streams of it start inside rocksdb(spark).
    """
    return bars.groupBy(*SERIES).transformWithStateInPandas(OpenBars(), SEEN, "Append", "EventTime")


def final_bars(bars: DataFrame, late: str = "6 hours") -> DataFrame:
    """Each bar of a stream once, when no correction of it is still to come.

    Bars that are sent again unchanged are dropped as they come. Of bars of one
    series and time that differ, the one of the largest volume stays, then the
    one of the largest values, so the result does not depend on the order in
    which they arrive. A bar is given when the watermark, `late` behind the
    newest bar, passes it.
    """
    names = [*SERIES, "ts", *VALUES]
    settle = ["settle_ts"] if "settle_ts" in bars.columns else []
    once = bars.select(*names, *settle).withWatermark("ts", late).dropDuplicatesWithinWatermark(names)
    ranked = F.max(F.struct("volume", *[v for v in VALUES if v != "volume"], *settle)).alias("v")
    return once.groupBy(*SERIES, "ts").agg(ranked).select(*SERIES, "ts", *[f"v.{v}" for v in VALUES], *[f"v.{c}" for c in settle])
