"""Conditions over pattern rows that may not look ahead, and columns derived under the same guard.

A field's metadata says whether it is an outcome. A guarded condition is
analysed on an empty table without the outcome fields, so Spark itself refuses
what is unknown there, with suggestions; taint of derived columns is found the
same way.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickwork.functions.scalars import truth

#: Fields that depend on later prices.
OUTCOMES = ("ratio", "univ_ratio", "univ_symbol", "state", "broke_out", "hold_candles", "peak_after")


class LookAheadError(ValueError):
    """A condition uses a field that is known only later, or that does not exist."""


def register_field(df: DataFrame, name: str, outcome: bool, description: str = "") -> DataFrame:
    """Mark a column as an outcome or not."""
    return df.withMetadata(name, {"outcome": outcome, "desc": description})


def register_outcomes(df: DataFrame) -> DataFrame:
    for name in df.columns:
        df = register_field(df, name, name in OUTCOMES)
    return df


def _is_outcome(f: T.StructField) -> bool:
    return bool(f.metadata.get("outcome", f.name in OUTCOMES))


def _empty(df: DataFrame, outcomes: bool) -> DataFrame:
    kept = [f for f in df.schema if outcomes or not _is_outcome(f)]
    return df.sparkSession.createDataFrame([], T.StructType(kept))


def _column(cond: str | Column) -> Column:
    return F.expr(cond) if isinstance(cond, str) else cond


def fill_numeric(df: DataFrame) -> DataFrame:
    """Missing numbers as 0, for the evaluation of conditions."""
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    return df.na.fill(0, numbers) if numbers else df


def _flag(df: DataFrame, cond: str | Column, name: str) -> DataFrame:
    """The condition as a column: evaluated with missing numbers as 0; numbers count as true unless 0, texts unless empty, null as false."""
    kind = _empty(df, True).select(_column(cond).alias("c")).schema["c"].dataType
    rows = df.select(F.struct(*df.columns).alias("__row"), *df.columns)
    flagged = fill_numeric(rows).withColumn(name, truth(_column(cond), kind.simpleString()))
    return flagged.select("__row.*", name)


def where_ex_ante(df: DataFrame, cond: str | Column) -> DataFrame:
    """Rows where the condition holds; it may not use outcomes."""
    try:
        _empty(df, False).where(truth(_column(cond), "boolean")).schema  # noqa: B018
    except AnalysisException as e:
        if e.getCondition() and e.getCondition().startswith("UNRESOLVED"):
            raise LookAheadError(f"not known when the signal fires: {e.getMessage()}") from e
        _empty(df, False).select(_column(cond).alias("c"))
    return _flag(df, cond, "__keep").where("__keep").drop("__keep")


def mark_success(df: DataFrame, cond: str | Column, name: str = "win") -> DataFrame:
    """The condition as a column; outcomes are allowed."""
    return _flag(df, cond, name)


def with_derived(df: DataFrame, definitions: list[tuple[str, str | Column]]) -> DataFrame:
    """Columns in order; each may use those before it. Taken names are refused, and what uses an outcome becomes one."""
    for name, cond in definitions:
        if name in df.columns:
            raise ValueError(f"{name} is taken")
        try:
            _empty(df, False).select(_column(cond).alias(name)).schema  # noqa: B018
            tainted = False
        except AnalysisException:
            tainted = True
        rows = df.select(F.struct(*df.columns).alias("__row"), *df.columns)
        df = fill_numeric(rows).withColumn(name, _column(cond)).select("__row.*", name)
        df = register_field(df, name, tainted, str(cond))
    return df


def unpopulated_fields(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field) of those columns that are null in every row."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in columns])
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in columns])).alias("x")).select("x.*")
    return long.where("n = 0").select("field")


def default_filter(signal: str, floor: float, max_tte: float | None = None, min_len: int | None = None, max_equal: int | None = None) -> Column:
    """The usual condition of a signal, made of its parameters."""
    cond = (F.col("signal") == signal) & (F.col("signal_value") >= floor)
    if max_tte is not None:
        cond = cond & (F.col("tte_hours") <= max_tte)
    if min_len is not None:
        cond = cond & (F.col("seq_length") >= min_len)
    if max_equal is not None and signal == "green_stairs":
        cond = cond & (F.col("equal_steps") <= max_equal)
    return cond


def check_floor(signal: str, floor: float, generated: dict[str, float]) -> None:
    """Refuses a calibration below the threshold that signals were generated with."""
    if floor < generated.get(signal, 0.0):
        raise ValueError(f"{signal} was generated from {generated[signal]} up; {floor} would miss rows")
