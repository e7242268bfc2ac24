"""Counts that come out of the job that makes the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """`df`, and an observation that holds these aggregates once an action has run over it."""
    seen = Observation()
    return df.observe(seen, *[c.alias(name) for name, c in counts.items()]), seen


def observe_excluded(tagged: DataFrame) -> tuple[DataFrame, Observation]:
    """Rows with moneyness; `excluded` counts those without."""
    rows, seen = observed(tagged, excluded=F.count_if(F.col("moneyness_bucket").isNull()))
    return rows.where("moneyness_bucket is not null"), seen


def observe_scan(trades: DataFrame, min_ratio: float) -> tuple[DataFrame, Observation]:
    """Trades of min_ratio or more; `raw_trades` and `qualifying` count all and those."""
    rows, seen = observed(trades, raw_trades=F.count(F.lit(1)), qualifying=F.count_if(F.col("ratio") >= min_ratio))
    return rows.where(F.col("ratio") >= min_ratio), seen


def observe_fields(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, Observation]:
    """The rows themselves; each column's count of values under its own name."""
    return observed(rows, **{c: F.count(F.col(f"`{c}`")) for c in columns})


def unpopulated(seen: Observation) -> list[str]:
    """Columns of observe_fields without any value."""
    return sorted(c for c, n in seen.get.items() if not n)
