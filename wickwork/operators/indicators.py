"""Moving averages, volatility and the boards built from them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickwork.functions.bands import EMA_SPREAD_BANDS, VOLATILITY_BANDS, band_tightest
from wickwork.functions.candles import SERIES, is_otm, with_instrument_cols
from wickwork.functions.scalars import half_up
from wickwork.operators.asof import latest_spot
from wickwork.operators.detect import body_distance

#: Fixed values.
EMA_PERIODS, WINDOWS, SERIES_POINTS = (20, 50, 100, 200), (5, 10), 240


#: Bars of a block, about: blocks are stretches of time.
BLOCK = 4096


def _block_sums(periods: tuple[int, ...]):
    """What a block does to the averages, as an affine map: y becomes scale * y + shift; and its part of the mean that seeds them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        close, before = pdf.sort_values("ts", kind="stable")["close"].to_numpy(float), int(pdf["__before"].iloc[0])
        out = {c: [pdf[c].iloc[0]] for c in (*SERIES, "__block")}
        for p in periods:
            first = min(len(close), max(0, p - before))
            y, a = 0.0, 2 / (p + 1)
            for x in close[first:].tolist():
                y = a * x + (1 - a) * y
            out |= {f"seed{p}": [float(close[:first].sum())], f"scale{p}": [(1 - a) ** (len(close) - first)], f"shift{p}": [y]}
        return pd.DataFrame(out)

    return run


def _carried(periods: tuple[int, ...]):
    """For each block of a series the sum of the first p closes and the average before it, from the maps of the blocks before."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__block")
        out = pdf[[*SERIES, "__block"]].copy()
        for p in periods:
            total, y, sums, ys = 0.0, None, [], []
            for n, seed, scale, shift in zip(pdf["__before"] + pdf["__n"], pdf[f"seed{p}"], pdf[f"scale{p}"], pdf[f"shift{p}"], strict=True):
                sums.append(total)
                ys.append(y)
                total += seed
                if n >= p:
                    y = scale * (total / p if y is None else y) + shift
            out[f"sum{p}"], out[f"from{p}"] = sums, np.array(ys, float)
        return out

    return run


def _averages(periods: tuple[int, ...]):
    def run(key: tuple, pdf: pd.DataFrame, carried: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        close = pdf["close"].to_numpy(float)
        for p in periods:
            out, before = np.full(len(close), np.nan), int(pdf["__before"].iloc[0]) if len(pdf) else 0
            y, first = float(carried[f"from{p}"].iloc[0]), max(0, p - before)
            if first and len(close) >= first:
                # The recurrence from the mean of the first p closes on, the last of which is in this block.
                y = (float(carried[f"sum{p}"].iloc[0]) + close[:first].sum()) / p
                out[first - 1] = y
            if first <= len(close) and not np.isnan(y):
                out[first:] = pd.Series(np.append(y, close[first:])).ewm(alpha=2 / (p + 1), adjust=False).mean().to_numpy()[1:]
            pdf[f"ema{p}"] = out
        return pdf.drop(columns="__before")

    return run


def ema(candles: DataFrame, periods: tuple[int, ...] = EMA_PERIODS) -> DataFrame:
    """ema{p} columns: the mean of the first p closes, then the recurrence; null before.

    A prefix scan: blocks of about BLOCK bars are summed up as affine maps, the
    maps of a series (a row a block) are composed, and each block is then worked
    out from what is carried into it. No task holds a series.
    """
    at = [*SERIES, "__block"]
    of = {f.name: f.dataType.simpleString() for f in candles.schema}
    rows = candles.withColumn("__block", F.floor(F.unix_seconds("ts") / (F.col("duration") * 60 * BLOCK)))
    counts = rows.groupBy(*at).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*SERIES).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("__before", F.coalesce(before, F.lit(0)))
    key = ", ".join(f"{c} {of[c]}" for c in SERIES) + ", __block bigint"
    named = lambda *parts: "".join(f", {x}{p} double" for p in periods for x in parts)
    placed = rows.join(counts.drop("__n"), at)
    sums = placed.select(*at, "__before", "ts", "close").groupBy(*at).applyInPandas(_block_sums(periods), key + named("seed", "scale", "shift"))
    carried = sums.join(counts, at).groupBy(*SERIES).applyInPandas(_carried(periods), key + named("sum", "from"))
    kinds = ", ".join(f"`{c}` {k}" for c, k in of.items())
    made = placed.groupBy(*at).cogroup(carried.groupBy(*at)).applyInPandas(_averages(periods), f"{kinds}, __block bigint" + "".join(f", ema{p} double" for p in periods)).drop("__block")
    return made.withColumns({f"ema{p}": F.when(~F.isnan(f"ema{p}"), F.col(f"ema{p}")) for p in periods})


def ema_spread(candles: DataFrame, periods: tuple[int, ...] = EMA_PERIODS) -> DataFrame:
    """spread_pct = (highest - lowest average) / close * 100 where all averages exist, to 6 places, and its band."""
    rows = ema(candles, periods)
    every = [F.col(f"ema{p}") for p in periods]
    ready = F.col("close") > 0
    for c in every:
        ready = ready & c.isNotNull()
    spread = F.when(ready, (F.greatest(*every) - F.least(*every)) / F.col("close") * 100)
    return rows.withColumn("__s", spread).withColumns({"spread_pct": half_up(F.col("__s"), 6), "spread_band": band_tightest(F.col("__s"), EMA_SPREAD_BANDS)}).drop("__s")


def price_volatility(candles: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """vol{w} = body distance over w bars / (open * close), to 6 places, and band{w}; null with fewer bars before."""
    usable = (F.col("open") > 0) & (F.col("close") > 0)
    rows = candles.withColumns({f"__v{w}": F.when(usable, body_distance(w) / (F.col("open") * F.col("close"))) for w in windows})
    made = {}
    for w in windows:
        made |= {f"vol{w}": half_up(F.col(f"__v{w}"), 6), f"band{w}": band_tightest(F.col(f"__v{w}"), VOLATILITY_BANDS)}
    return rows.withColumns(made).drop(*[f"__v{w}" for w in windows])


def volatility_board(candles: DataFrame, spot: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """The newest volatility of each series with more than ten bars, and whether it is out of the money at the latest spot."""
    last = Window.partitionBy(*SERIES).orderBy(F.desc("ts"))
    size = F.count("*").over(Window.partitionBy(*SERIES))
    rows = price_volatility(candles, windows).withColumns({"__k": F.row_number().over(last), "__n": size}).where("__k = 1 and __n > 10").drop("__k", "__n")
    named = with_instrument_cols(rows).join(latest_spot(spot).withColumnRenamed("close", "spot_close"), "spot", "left")
    return named.withColumn("otm", is_otm(F.col("opt_type"), F.col("strike"), F.col("spot_close"))).drop("opt_spot", "code")


def atm_strike(board: DataFrame) -> DataFrame:
    """Per chain and type the symbol nearest to spot; of two equally near the lower strike."""
    near = F.struct(F.abs(F.col("strike") - F.col("spot_close")).alias("d"), F.col("strike"), F.col("symbol"))
    rows = board.where("spot_close is not null and strike is not null")
    return rows.groupBy("spot", "expiry", "duration", "opt_type").agg(F.min_by("symbol", near).alias("symbol"), F.min_by("strike", near).alias("strike"))


def last_points(rows: DataFrame, n: int = SERIES_POINTS) -> DataFrame:
    """The newest n rows of each series."""
    k = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("ts")))
    return rows.withColumn("__k", k).where(F.col("__k") <= n).drop("__k")
