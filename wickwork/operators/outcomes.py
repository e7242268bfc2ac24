"""What happened after each bar and after each signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickwork.functions.candles import SERIES
from wickwork.functions.scalars import half_up


def with_peak_after(candles: DataFrame, series: list[str] | None = None) -> DataFrame:
    """peak_after: the highest high strictly later in the series, null on the last bar; peak_bars: how many bars later it first stands.

    The frame runs backwards from the end, so each bar costs one step.
    """
    by = series or SERIES
    back = Window.partitionBy(*by).orderBy(F.desc("ts"))
    ranked = candles.withColumn("__n", F.row_number().over(back))
    # Of equal highs the one furthest from the end comes first in time.
    best = F.max(F.struct("high", "__n")).over(back.rowsBetween(Window.unboundedPreceding, -1))
    return ranked.withColumn("__p", best).withColumns({"peak_after": F.col("__p.high"), "peak_bars": F.col("__n") - F.col("__p.__n")}).drop("__n", "__p")


def rounded_peak(peak: Column) -> Column:
    return F.when(F.col("signal") == "red_squeeze", half_up(peak, 3)).otherwise(half_up(peak, 4))


def annotate_outcomes(signals: DataFrame) -> DataFrame:
    """state, ratio and broke_out from trigger_high and peak_after: activated if the peak is above the trigger, else slHit; pending on the last bar.

    The trigger is compared unrounded. peak_after keeps 3 places for red_squeeze and 4 for the other signals.
    """
    peak, trigger = F.col("peak_after"), F.col("trigger_high")
    return signals.withColumns(
        {
            "state": F.when(peak.isNull(), "pending").when(peak > trigger, "activated").otherwise("slHit"),
            "broke_out": F.coalesce(peak > trigger, F.lit(False)),
            "ratio": F.when(peak.isNull() | (trigger <= 0), 0.0).otherwise(half_up(F.try_divide(peak, trigger), 3)),
            "peak_after": F.coalesce(rounded_peak(peak), F.lit(0.0)),
            "hold_candles": F.col("peak_bars"),
        }
    ).drop("peak_bars")
