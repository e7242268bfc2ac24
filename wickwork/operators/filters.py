"""Filters on signals, events and trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickwork.functions.candles import with_instrument_cols
from wickwork.operators.asof import with_spot_bar
from wickwork.operators.settlement import tte_hours

#: Fixed values.
CUTOFF_HOURS, BIG_BODY, RECENT_HOURS = 1.5, 0.6, 48


def apply_firing_cutoff(signals: DataFrame, hours: float = CUTOFF_HOURS) -> DataFrame:
    """Signals with at least `hours` to settlement (column settle_ts) at entry; 0 and less keep all, an unknown settlement is kept."""
    if hours <= 0:
        return signals
    left = tte_hours("entry_ts")
    return signals.where(left.isNull() | (left >= hours))


def apply_opposite_filter(signals: DataFrame, spot: DataFrame | None = None, fraction: float = BIG_BODY) -> DataFrame:
    """Without calls on a big red spot bar and puts on a big green one; big is a body of `fraction` of the range. No bar: kept.

    The bar is that of the signal's duration at its entry: the column spot_bar, or looked up in `spot`.
    """
    rows = with_instrument_cols(signals if "spot_bar" in signals.columns else with_spot_bar(signals, spot, "entry_ts"))
    span = F.col("spot_bar.high") - F.col("spot_bar.low")
    move = F.col("spot_bar.close") - F.col("spot_bar.open")
    big = (span > 0) & (F.try_divide(F.abs(move), span) >= fraction)
    against = big & F.when(F.col("opt_type") == "C", move < 0).when(F.col("opt_type") == "P", move > 0).otherwise(False)
    return rows.where(~F.coalesce(against, F.lit(False))).select(*signals.columns)


def ratio_filter(df: DataFrame, column: str, op: str = ">=", low: float = 0.0, high: float | None = None) -> DataFrame:
    """>, >=, <, <= or a closed range ('between')."""
    c = F.col(column)
    tests = {">": lambda: c > low, ">=": lambda: c >= low, "<": lambda: c < low, "<=": lambda: c <= low, "between": lambda: c.between(low, high)}
    return df.where(tests[op]())


def calibrate(events: DataFrame, low: float | None = None, high: float | None = None, min_count: int | None = None, duration: int | None = None, kind: str | None = None) -> DataFrame:
    """Events in a range of values, with a least number of firings, of one duration and type; what is None is not asked for."""
    tests = [(low, F.col("max_value") >= F.lit(low)), (high, F.col("max_value") < F.lit(high)), (min_count, F.col("n") >= F.lit(min_count)), (duration, F.col("duration") == F.lit(duration)), (kind, F.col("type") == F.lit(kind))]
    for asked, test in tests:
        if asked is not None:
            events = events.where(test)
    return events


def payoff(source: str) -> Column:
    """The ratio of the firing itself ('fired') or of the whole chain ('universe')."""
    return {"fired": F.col("max_ratio"), "universe": F.coalesce("univ_ratio", F.lit(0.0))}[source]


def filter_best_trades(df: DataFrame, min_ratio: float = 0.0, kind: str | None = None, otm: bool | None = None, expiry: str | None = None) -> DataFrame:
    rows = with_instrument_cols(df).where(F.col("ratio") >= min_ratio)
    if kind:
        rows = rows.where(F.col("opt_type") == kind)
    if otm is not None:
        rows = rows.where(F.col("entry_otm") == otm)
    if expiry:
        rows = rows.where(F.col("expiry") == F.lit(expiry).cast("date"))
    return rows.select(*df.columns)


def settled_between(df: DataFrame, low: str, high: str, spot: str | None = None) -> DataFrame:
    """Expiries in a closed range of dates; on tables partitioned by spot and expiry this prunes."""
    rows = df.where(F.col("expiry").between(F.lit(low).cast("date"), F.lit(high).cast("date")))
    return rows.where(F.col("spot") == spot) if spot else rows


def recent(df: DataFrame, now: Column, hours: float = RECENT_HOURS, at: str = "entry_ts") -> DataFrame:
    return df.where(F.unix_seconds(at) >= F.unix_seconds(now) - int(hours * 3600))
