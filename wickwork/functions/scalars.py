"""Scalar functions with the missing-is-zero semantics that conditions over signals rely on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def half_up(c: Column, places: int = 0) -> Column:
    """Rounds halves toward positive infinity."""
    scale = 10.0**places
    return F.floor(c * scale + 0.5) / scale


def log10(c: Column) -> Column:
    return F.when(c > 0, F.log10(c)).otherwise(0.0)


def log(c: Column) -> Column:
    return F.when(c > 0, F.ln(c)).otherwise(0.0)


def sqrt(c: Column) -> Column:
    return F.when(c >= 0, F.sqrt(c)).otherwise(0.0)


def divide(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or either is missing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def variadic(many: Callable[..., Column]) -> Callable[..., Column]:
    return lambda *c: c[0] if len(c) == 1 else many(*c)


def truth(c: Column, kind: str) -> Column:
    """Numbers other than zero, texts other than empty and true are true; null is false."""
    test = c if kind == "boolean" else c != ("" if kind == "string" else 0)
    return F.coalesce(test, F.lit(False))


NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _is_number(c: Column) -> Column:
    return F.typeof(c).isin(*NUMBERS) | F.typeof(c).startswith("decimal")


def number(c: Column) -> Column:
    """A value as a number: true is 1; texts, whatever they hold, and missing values are 0. Never fails."""
    return F.coalesce(F.when(_is_number(c), c.try_cast("double")), F.when((F.typeof(c) == "boolean") & (c.cast("string") == "true"), 1.0), F.lit(0.0))


def loose_equal(a: Column, b: Column) -> Column:
    """Compared as numbers where either side is one, else as texts, where two missing values are equal. Never null, never fails."""
    numeric = _is_number(a) | _is_number(b)
    return F.when(numeric, number(a) == number(b)).otherwise(a.cast("string").eqNullSafe(b.cast("string")))


def loose_in(a: Column, *among: Column) -> Column:
    """Whether any of these is loosely equal."""
    out = F.lit(False)
    for b in among:
        out = out | loose_equal(a, b)
    return out


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "log10": log10, "log": log, "exp": F.exp, "sqrt": sqrt, "abs": F.abs, "floor": F.floor, "ceil": F.ceil,
    "sign": F.signum, "round": lambda c: F.floor(c + 0.5), "pow": F.pow, "divide": divide,
    "min": variadic(F.least), "max": variadic(F.greatest), "eq": loose_equal, "ne": lambda a, b: ~loose_equal(a, b), "in": loose_in,
}


def register_function(name: str, make: Callable[..., Column]) -> None:
    """Add a function for conditions built in Python; a taken name is refused."""
    if name in FUNCTIONS:
        raise ValueError(f"{name} is taken")
    FUNCTIONS[name] = make


#: The same functions for conditions written in SQL, under names that no built-in has.
SQL_FUNCTIONS = {
    "log10_0": ("x double", "double", "CASE WHEN x > 0 THEN log10(x) ELSE 0 END"),
    "log_0": ("x double", "double", "CASE WHEN x > 0 THEN ln(x) ELSE 0 END"),
    "sqrt_0": ("x double", "double", "CASE WHEN x >= 0 THEN sqrt(x) ELSE 0 END"),
    "div_0": ("a double, b double", "double", "coalesce(try_divide(a, b), 0)"),
    # Equality of two numbers, of a text and a number (the text counts as 0) and of two texts.
    "eq_0": ("a double, b double", "boolean", "coalesce(a, 0) = coalesce(b, 0)"),
    "eq_text_0": ("t string, x double", "boolean", "coalesce(x, 0) = 0"),
    "eq_texts": ("a string, b string", "boolean", "a <=> b"),
    "round_up": ("x double", "double", "floor(x + 0.5)"),
}


def register_sql(spark: SparkSession, more: dict[str, tuple[str, str, str]] | None = None) -> None:
    """Create the SQL functions in the session; `more` adds to them and may not replace a name."""
    if taken := set(more or {}) & set(SQL_FUNCTIONS):
        raise ValueError(f"{sorted(taken)} are taken")
    for name, (arguments, kind, body) in (SQL_FUNCTIONS | (more or {})).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
