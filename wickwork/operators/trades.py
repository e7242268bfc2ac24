"""Trades in hindsight: the best one of each series, and the partition of a series into all of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickwork.functions.candles import SERIES, is_otm, signed_distance, with_instrument_cols
from wickwork.functions.scalars import half_up
from wickwork.operators.asof import with_spot
from wickwork.operators.outcomes import with_peak_after

MAX_TRADES, MIN_RATIO = 200, 5.0


def finest(candles: DataFrame) -> DataFrame:
    """Candles of the shortest duration that is stored for each (spot, expiry)."""
    least = F.min("duration").over(Window.partitionBy("spot", "expiry"))
    return candles.withColumn("__d", least).where("duration = __d").drop("__d")


def best_trade(candles: DataFrame, min_ratio: float = 0.0) -> DataFrame:
    """One row per series: the entry close with the best ratio of a later high to it.

    Of equal ratios the last entry counts, and of equal highs the last peak.
    """
    forward = Window.partitionBy(*SERIES).orderBy("ts")
    later = Window.partitionBy(*SERIES).orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, -1)
    rows = candles.withColumn("__n", F.row_number().over(forward)).withColumn("__p", F.max(F.struct("high", "__n", "ts")).over(later))
    rows = rows.where("close > 0 and __p.high > 0").withColumn("__r", F.col("__p.high") / F.col("close"))
    bars = candles.groupBy(*SERIES).agg(F.count("*").alias("candles"), F.min("ts").alias("first_ts"))
    top = rows.groupBy(*SERIES).agg(F.max(F.struct(F.col("__r"), F.col("__n"), F.col("ts"), F.col("close"), F.col("__p"))).alias("b"))
    out = top.join(bars, SERIES).select(
        *SERIES, half_up(F.col("b.__r"), 2).alias("ratio"), F.col("b.ts").alias("entry_ts"), F.col("b.close").alias("entry_price"), F.col("b.__p.ts").alias("peak_ts"),
        F.col("b.__p.high").alias("peak_price"), (F.col("b.__p.__n") - F.col("b.__n")).alias("hold_candles"),
        half_up((F.unix_seconds("b.__p.ts") - F.unix_seconds("b.ts")) / 3600, 1).alias("hold_hours"), "first_ts", "candles",
    )
    return out.where(F.col("ratio") >= min_ratio)


class Extremes:
    """Place of the first largest (sign 1) or smallest (sign -1) value of any stretch, by a sparse table: one comparison a question."""

    def __init__(self, values: np.ndarray, sign: int):
        self.values = values * sign
        self.rows = [np.arange(len(values), dtype=np.int32)]
        while (step := 1 << len(self.rows) - 1) * 2 <= len(values):
            a, b = self.rows[-1][:-step], self.rows[-1][step:]
            self.rows.append(np.where(self.values[b] > self.values[a], b, a))

    def __call__(self, a: int, b: int) -> int:
        """Of the stretch [a, b), which is not empty."""
        k = (b - a).bit_length() - 1
        x, y = int(self.rows[k][a]), int(self.rows[k][b - (1 << k)])
        return y if self.values[y] > self.values[x] else x


def _partition(cap: int):
    """All trades of one series: the highest high and the lowest low before it, then the bars left of the low and right of the high.

    Stretches to the right are split first; with a cap that order is part of the result.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        high, low, ts = pdf["high"].to_numpy(float), pdf["low"].to_numpy(float), pdf["ts"].to_numpy()
        highest, lowest = Extremes(high, 1), Extremes(low, -1)
        todo, found = [(0, len(pdf))], []
        while todo and len(found) < cap:
            a, b = todo.pop()
            if b - a < 2:
                continue
            top = highest(a, b)
            if top == a:
                todo.append((a + 1, b))
                continue
            bottom = lowest(a, top)
            if low[bottom] > 0 and high[top] > 0:
                found.append((bottom, top))
            todo += [(a, bottom), (top + 1, b)]
        i, j = (np.array(x, int) for x in (zip(*found, strict=True) if found else ((), ())))
        key = {c: pdf[c].iloc[0] for c in SERIES}
        out = pd.DataFrame({"low_ts": ts[i], "high_ts": ts[j], "low_price": low[i], "high_price": high[j], "hold_candles": (j - i).astype("int32")})
        return out.assign(**key)[[*SERIES, "low_ts", "high_ts", "low_price", "high_price", "hold_candles"]]

    return run


def find_trades(candles: DataFrame, cap: int = MAX_TRADES, min_ratio: float = MIN_RATIO) -> DataFrame:
    """Every trade of every series, at most `cap` a series, those with a ratio (2 places) of min_ratio or more.

    A group is one series.
    """
    kinds = {f.name: f.dataType.simpleString() for f in candles.schema}
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in SERIES], "low_ts timestamp, high_ts timestamp, low_price double, high_price double, hold_candles int"])
    found = candles.select(*SERIES, "ts", "high", "low").groupBy(*SERIES).applyInPandas(_partition(cap), schema)
    return found.withColumn("ratio", half_up(F.col("high_price") / F.col("low_price"), 2)).where(F.col("ratio") >= min_ratio)


def trade_moneyness(df: DataFrame, spot: DataFrame, at: str, symbol: str) -> DataFrame:
    """Spot at the entry (2 places), signed distance (1 place) and whether it was out of the money."""
    named = with_instrument_cols(with_spot(df, spot, at), symbol)
    kind, strike, price = F.col("opt_type"), F.col("strike"), F.col("spot_close")
    out = named.withColumns(
        {"spot_at_entry": half_up(price, 2), "entry_distance": half_up(signed_distance(kind, strike, price), 1), "entry_otm": F.when(price.isNotNull(), is_otm(kind, strike, price))}
    )
    return out.drop("spot_close", "opt_type", "opt_spot", "strike", "code")


def scan_stats(candles: DataFrame, trades: DataFrame, min_ratio: float = MIN_RATIO) -> DataFrame:
    """Per (spot, expiry): instruments scanned, raw trades and qualifying trades."""
    seen = candles.groupBy("spot", "expiry").agg(F.count_distinct("symbol").alias("scanned"))
    made = trades.groupBy("spot", "expiry").agg(F.count("*").alias("raw_trades"), F.count_if(F.col("ratio") >= min_ratio).alias("qualifying"))
    return seen.join(made, ["spot", "expiry"], "left").na.fill(0, ["raw_trades", "qualifying"])


__all__ = ["best_trade", "find_trades", "finest", "scan_stats", "trade_moneyness", "with_peak_after"]
