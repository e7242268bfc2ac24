"""Best payoff anywhere on the chain at the time of a signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickwork.functions.candles import is_otm, with_instrument_cols
from wickwork.functions.scalars import half_up
from wickwork.operators.asof import with_spot
from wickwork.operators.outcomes import with_peak_after

SLOT = ["spot", "expiry", "duration", "opt_type", "ts"]


def universe_max(signals: DataFrame, candles: DataFrame, spot: DataFrame | None = None, mode: str = "all_same_type", otm_only: bool = False) -> DataFrame:
    """univ_ratio and univ_symbol: the best peak_after / close of an option of the same type with a bar at the entry's time.

    all_same_type looks at every strike, further_otm at the firing strike and
    those further out; otm_only leaves out what is not out of the money at the
    entry's spot. Ratios have 3 places, 0 and null without any. Equal ratios go
    to the smallest symbol. One row per slot and type, or per strike, is joined
    on equal keys; candidates are never paired with signals.
    """
    chain = with_instrument_cols(candles if "peak_after" in candles.columns else with_peak_after(candles)).where("opt_type is not null and strike is not null and close > 0 and peak_after is not null")
    if otm_only and (spot is not None or "spot_close" in chain.columns):
        chain = (chain if "spot_close" in chain.columns else with_spot(chain, spot)).where(F.col("spot_close").isNull() | is_otm(F.col("opt_type"), F.col("strike"), F.col("spot_close")))
    ratio = F.col("peak_after") / F.col("close")
    chain = chain.select(*SLOT, "strike", "symbol", ratio.alias("r")).where("r > 0")
    named = with_instrument_cols(signals)
    sig = named.withColumn("ts", F.col("entry_ts"))
    if mode == "all_same_type":
        # The smallest of (-ratio, symbol): of equal ratios the smallest symbol.
        top = chain.groupBy(*SLOT).agg(F.min(F.struct((-F.col("r")).alias("r"), "symbol")).alias("m"))
        best = top.select(*SLOT, (-F.col("m.r")).alias("__r"), F.col("m.symbol").alias("__s"))
        out = sig.join(best, SLOT, "left")
    elif mode == "further_otm":
        per = chain.groupBy(*SLOT, "strike").agg(F.max("r").alias("r"), F.min_by("symbol", F.struct(-F.col("r"), F.col("symbol"))).alias("s"))
        # Calls count from the highest strike down, puts from the lowest up; equal strikes share a frame.
        order = F.when(F.col("opt_type") == "C", -F.col("strike")).otherwise(F.col("strike"))
        growing = Window.partitionBy(*SLOT).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        per = per.withColumn("__m", F.min(F.struct((-F.col("r")).alias("r"), F.col("s").alias("s"))).over(growing))
        per = per.select(*SLOT, "strike", (-F.col("__m.r")).alias("__r"), F.col("__m.s").alias("__s"))
        # A strike without a candidate of its own takes the nearest one further out.
        fired = sig.select(*SLOT, "strike").distinct()
        side = F.when(F.col("opt_type") == "C", -F.col("strike")).otherwise(F.col("strike"))
        both = per.withColumn("__own", F.lit(0)).unionByName(fired.withColumn("__own", F.lit(1)), allowMissingColumns=True).withColumn("__o", side)
        w = Window.partitionBy(*SLOT).orderBy("__o", "__own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        carry = F.last(F.when(F.col("__own") == 0, F.struct("__r", "__s")), ignorenulls=True).over(w)
        best = both.withColumn("__c", carry).where("__own = 1").select(*SLOT, "strike", F.col("__c.__r").alias("__r"), F.col("__c.__s").alias("__s"))
        out = sig.join(best, [*SLOT, "strike"], "left")
    else:
        raise ValueError(f"unknown mode {mode}")
    return out.select(*[out[c] if c in out.columns else F.lit(None) for c in signals.columns], F.coalesce(half_up(F.col("__r"), 3), F.lit(0.0)).alias("univ_ratio"), F.col("__s").alias("univ_symbol"))
