"""Candle predicates, option symbols and moneyness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickwork.functions.scalars import half_up

#: Columns that identify one series of candles.
SERIES = ["spot", "expiry", "duration", "symbol"]


def body() -> Column:
    return F.abs(F.col("close") - F.col("open"))


def is_red() -> Column:
    return F.col("close") < F.col("open")


def is_green() -> Column:
    return F.col("close") > F.col("open")


def is_flat() -> Column:
    return F.col("close") == F.col("open")


def is_dead() -> Column:
    """Open, high, low and close are one price."""
    return (F.col("open") == F.col("close")) & (F.col("high") == F.col("low")) & (F.col("open") == F.col("high"))


def oc_max() -> Column:
    return F.greatest("open", "close")


def oc_min() -> Column:
    return F.least("open", "close")


def with_instrument_cols(df: DataFrame, symbol: str = "symbol") -> DataFrame:
    """opt_type, opt_spot, strike and code of symbols {type}-{spot}-{strike}-{code}; an invalid strike is null."""
    part = F.split(F.col(symbol), "-")
    kind = F.get(part, F.lit(0))
    return df.withColumns(
        {"opt_type": F.when(kind.isin("C", "P"), kind), "opt_spot": F.get(part, F.lit(1)), "strike": F.get(part, F.lit(2)).try_cast("double"), "code": F.get(part, F.lit(3))}
    )


def is_otm(kind: Column, strike: Column, spot: Column) -> Column:
    """Out of the money; false where anything is missing."""
    return F.coalesce(F.when(kind == "C", strike > spot).when(kind == "P", strike < spot), F.lit(False))


def signed_distance(kind: Column, strike: Column, spot: Column) -> Column:
    """Percent from spot, positive out of the money for calls and puts alike; null without a positive spot."""
    return F.when(spot > 0, F.when(kind == "C", 1.0).otherwise(-1.0) * (strike - spot) / spot * 100)


def distance_pct(kind: Column, strike: Column, spot: Column) -> Column:
    """signed_distance to 3 places, 0 without spot."""
    return F.coalesce(half_up(signed_distance(kind, strike, spot), 3), F.lit(0.0))


def strength(low_sum: Column, close: Column, bars: Column, spot: Column) -> tuple[Column, Column]:
    """(average price to 4 places, spot / average to 3 places) over the pattern's lows and the trigger's close; 0 unless positive."""
    mean = (low_sum + close) / (bars + 1)
    value = F.when((mean > 0) & (spot > 0), half_up(spot / mean, 3)).otherwise(0.0)
    return half_up(mean, 4), value
