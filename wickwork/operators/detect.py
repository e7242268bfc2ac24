"""Sequential bar patterns, found with windows over each series.

All detectors take candles that with_peak_after has been through, and return
one row per firing with the columns of SIGNAL. The first bar of a series never
takes part. Runs get an id by counting their starts; a second window inside
(series, run) needs no further shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickwork.functions.candles import SERIES, body, distance_pct, is_dead, is_green, is_otm, is_red, oc_max, oc_min, strength, with_instrument_cols
from wickwork.functions.scalars import half_up
from wickwork.operators.asof import with_spot
from wickwork.operators.outcomes import annotate_outcomes

#: Fixed values of the patterns.
MIN_SEQ, RED_THRESHOLD, OTM_THRESHOLD, MAX_EQUAL = 3, 15.0, 1000.0, 1
LOOKBACK, JUMP, CLOSE_MULTIPLE = 5, 2.0, 1.35

#: Columns of a firing and their types; a detector leaves null what its pattern does not have.
SIGNAL = {
    "signal": "string", "entry_ts": "timestamp", "entry_price": "double", "pattern_start": "timestamp", "seq_length": "int", "equal_steps": "int",
    "first_body": "double", "last_body": "double", "trigger_body": "double", "pattern_high": "double", "pattern_low": "double",
    "ratio1": "double", "ratio2": "double", "avg_price": "double", "spot_price": "double", "distance_pct": "double",
    "dist": "double", "log_value": "double", "log_jump": "double", "signal_value": "double",
    "trigger_high": "double", "trigger_price": "double", "peak_after": "double", "peak_bars": "int",
}


def _shape(df: DataFrame, signal: str, places: int = 4, **given: Column) -> DataFrame:
    """Rows of SIGNAL: the entry bar's columns, what the detector gives, and nulls."""
    entry = {"signal": F.lit(signal), "entry_ts": F.col("ts"), "entry_price": F.col("close"), "trigger_high": F.col("high"), "trigger_price": half_up(F.col("high"), places), "peak_after": F.col("peak_after"), "peak_bars": F.col("peak_bars")}
    have = entry | given
    return df.select(*SERIES, *[have.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in SIGNAL.items()], *[c for c in df.columns if c == "spot_bar"])


def _numbered(candles: DataFrame, least: int) -> DataFrame:
    """Series of `least` bars and more, with bar number, body and the bar before."""
    s, t = Window.partitionBy(*SERIES), Window.partitionBy(*SERIES).orderBy("ts")
    n = candles.withColumns({"__n": F.row_number().over(t), "__size": F.count("*").over(s), "body": body()})
    return n.where(F.col("__size") >= least)


def _red_runs(candles: DataFrame, min_seq: int) -> DataFrame:
    """Green bars that follow a run of at least min_seq red bars with shrinking bodies, with the run's figures."""
    t = Window.partitionBy(*SERIES).orderBy("ts")
    red = is_red() & (F.col("__n") > 1)
    rows = _numbered(candles, min_seq + 2).withColumn("__red", red)
    rows = rows.withColumns({"__prev": F.coalesce(F.lag("__red").over(t), F.lit(False)), "__body": F.lag("body").over(t)})
    start = F.col("__red") & ~(F.col("__prev") & (F.col("body") < F.col("__body")))
    rows = rows.withColumn("__run", F.sum(F.when(start, 1).otherwise(0)).over(t))
    inside = Window.partitionBy(*SERIES, "__run").orderBy("ts")
    sofar = inside.rowsBetween(Window.unboundedPreceding, -1)
    mine = lambda c: F.when(F.col("__red"), F.col(c))
    runs = rows.withColumns(
        {
            "run_len": F.count(mine("body")).over(sofar),
            "first_body": F.first(mine("body"), ignorenulls=True).over(sofar),
            "last_body": F.last(mine("body"), ignorenulls=True).over(sofar),
            "run_start": F.min(mine("ts")).over(sofar),
            "run_lows": F.sum(mine("low")).over(sofar),
            "run_low": F.min(mine("low")).over(sofar),
            "run_high": F.max(mine("high")).over(sofar),
            # The spot that the run's first bar has seen; candles without spot have none.
            "run_spot": F.min(F.when(F.col("__red"), F.struct("ts", spot_seen(candles).alias("s")))).over(sofar)["s"],
        }
    )
    return runs.where(is_green() & F.col("__prev") & (F.col("run_len") >= min_seq))


def detect_red_squeeze(candles: DataFrame, spot: DataFrame | None = None, min_seq: int = MIN_SEQ, min_value: float = RED_THRESHOLD) -> DataFrame:
    """Red bodies that shrink, then a green bar: fires if first/last body or first/green body reaches min_value."""
    runs = _red_runs(candles, min_seq)
    r1, r2 = F.col("first_body") / F.col("last_body"), F.col("first_body") / F.col("body")
    found = runs.withColumn("__v", F.greatest(r1, r2)).where(F.col("__v") >= min_value)
    return _shape(
        found, "red_squeeze", 3, pattern_start=F.col("run_start"), seq_length=F.col("run_len"),
        first_body=half_up(F.col("first_body"), 3), last_body=half_up(F.col("last_body"), 3), trigger_body=half_up(F.col("body"), 3),
        pattern_low=half_up(F.least("run_low", "low"), 3), ratio1=half_up(r1, 3), ratio2=half_up(r2, 3), signal_value=half_up(F.col("__v"), 3),
    )


def spot_seen(candles: DataFrame) -> Column:
    """The spot close at each bar, where there is one."""
    return F.col("spot_close") if "spot_close" in candles.columns else F.lit(None).cast("double")


def _spotted(candles: DataFrame, spot: DataFrame | None) -> DataFrame:
    """Candles with spot_close: each bar looks it up once, and patterns take that of their first bar."""
    return candles if "spot_close" in candles.columns else with_spot(candles, spot)


def _otm(rows: DataFrame) -> DataFrame:
    """Rows that are out of the money at run_spot, which becomes their spot_close."""
    named = with_instrument_cols(rows.withColumn("spot_close", F.col("run_spot")))
    return named.where(is_otm(F.col("opt_type"), F.col("strike"), F.col("spot_close")))


def _distance() -> Column:
    return distance_pct(F.col("opt_type"), F.col("strike"), F.col("spot_close"))


def detect_otm_red_squeeze(candles: DataFrame, spot: DataFrame, min_seq: int = MIN_SEQ, min_value: float = OTM_THRESHOLD) -> DataFrame:
    """The same shape out of the money at its start; the value is spot over the mean of the pattern's lows and the entry's close."""
    rows = _otm(_red_runs(_spotted(candles, spot), min_seq))
    average, value = strength(F.col("run_lows") + F.col("low"), F.col("close"), F.col("run_len") + 1, F.col("spot_close"))
    found = rows.withColumns({"__avg": average, "__v": value}).where(F.col("__v") >= min_value)
    return _shape(
        found, "otm_red_squeeze", pattern_start=F.col("run_start"), seq_length=F.col("run_len"),
        first_body=half_up(F.col("first_body"), 3), last_body=half_up(F.col("last_body"), 3), trigger_body=half_up(F.col("body"), 3),
        pattern_high=F.greatest("run_high", "high"), pattern_low=half_up(F.least("run_low", "low"), 4),
        ratio1=half_up(F.col("first_body") / F.col("last_body"), 3), ratio2=half_up(F.col("first_body") / F.col("body"), 3),
        avg_price=F.col("__avg"), spot_price=half_up(F.col("spot_close"), 3), distance_pct=_distance(), signal_value=F.col("__v"),
    )


def detect_green_stairs(candles: DataFrame, spot: DataFrame, min_seq: int = MIN_SEQ, max_equal: int = MAX_EQUAL, min_value: float = OTM_THRESHOLD) -> DataFrame:
    """Green bodies that rise, with at most max_equal equal steps a run; fires on the last step.

    A chain is a maximal stretch of green bars whose bodies do not fall; every
    max_equal + 1 equal steps in it a new run begins.
    """
    t, candles = Window.partitionBy(*SERIES).orderBy("ts"), _spotted(candles, spot)
    rows = _numbered(candles, min_seq + 2).withColumn("__g", is_green() & (F.col("__n") > 1))
    rows = rows.withColumns({"__prev": F.coalesce(F.lag("__g").over(t), F.lit(False)), "__body": F.lag("body").over(t)})
    chained = F.col("__g") & F.col("__prev") & (F.col("body") >= F.col("__body"))
    rows = rows.withColumns(
        {"__chain": F.sum(F.when(F.col("__g") & ~chained, 1).otherwise(0)).over(t), "__equal": F.when(chained & (F.col("body") == F.col("__body")), 1).otherwise(0)}
    ).where("__g")
    rows = rows.withColumn("__steps", F.sum("__equal").over(Window.partitionBy(*SERIES, "__chain").orderBy("ts")))
    rows = rows.withColumn("__part", F.floor(F.col("__steps") / (max_equal + 1)))
    run = Window.partitionBy(*SERIES, "__chain", "__part")
    asc = run.orderBy("ts")
    whole = asc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The step that opens a run by exhausting the budget is no equal step of it.
    runs = rows.withColumns(
        {
            "run_len": F.count("*").over(whole), "nth": F.row_number().over(asc), "run_start": F.first("ts").over(whole), "run_spot": F.first("spot_close").over(whole), "first_body": F.first("body").over(whole),
            "run_lows": F.sum("low").over(whole), "run_low": F.min("low").over(whole), "run_high": F.max("high").over(whole),
            "equal": F.sum("__equal").over(whole) - F.when(F.col("__part") > 0, 1).otherwise(0),
        }
    ).where((F.col("nth") == F.col("run_len")) & (F.col("run_len") >= min_seq))
    named = _otm(runs)
    average, value = strength(F.col("run_lows"), F.col("close"), F.col("run_len"), F.col("spot_close"))
    found = named.withColumns({"__avg": average, "__v": value}).where(F.col("__v") >= min_value)
    return _shape(
        found, "green_stairs", pattern_start=F.col("run_start"), seq_length=F.col("run_len"), equal_steps=F.col("equal"),
        first_body=half_up(F.col("first_body"), 3), last_body=half_up(F.col("body"), 3), trigger_body=half_up(F.col("body"), 3),
        pattern_high=F.col("run_high"), pattern_low=half_up(F.col("run_low"), 4), ratio1=half_up(F.col("body") / F.col("first_body"), 3), ratio2=F.lit(0.0),
        avg_price=F.col("__avg"), spot_price=half_up(F.col("spot_close"), 3), distance_pct=_distance(), signal_value=F.col("__v"),
    )


def body_distance(bars: int) -> Column:
    """Sum over the `bars` bars before of how far this body's edges lie from theirs; null with fewer bars."""
    t = Window.partitionBy(*SERIES).orderBy("ts")
    total = F.lit(0.0)
    for k in range(1, bars + 1):
        total = total + (F.abs(oc_max() - F.lag(oc_max(), k).over(t)) + F.abs(oc_min() - F.lag(oc_min(), k).over(t)))
    return total


def with_wall_value(candles: DataFrame) -> DataFrame:
    """dist and wall_value = log10(open * close * dist^2); null where nothing moved, all bars before are dead or the product is not positive."""
    t = Window.partitionBy(*SERIES).orderBy("ts")
    rows = candles.withColumns({"dist": body_distance(LOOKBACK), "__dead": is_dead().cast("int")})
    dead = sum((F.lag("__dead", k).over(t) for k in range(2, LOOKBACK + 1)), F.lag("__dead", 1).over(t))
    size = F.col("open") * F.col("close") * F.col("dist") * F.col("dist")
    value = F.when((F.col("dist") > 0) & (dead < LOOKBACK) & (size > 0), F.log10(size))
    return rows.withColumn("wall_value", value).drop("__dead")


def detect_otm_wall(candles: DataFrame, spot: DataFrame, min_value: float = JUMP, multiple: float = CLOSE_MULTIPLE) -> DataFrame:
    """A green bar whose wall value jumps by min_value over one of the two bars before, closing at least `multiple` times that bar's close."""
    t = Window.partitionBy(*SERIES).orderBy("ts")
    rows = with_wall_value(_numbered(_spotted(candles, spot), LOOKBACK + 2))
    jumps = {}
    for k in (1, 2):
        jump = F.col("wall_value") - F.lag("wall_value", k).over(t)
        jumps[f"__j{k}"] = F.when((jump >= min_value) & (F.col("close") >= multiple * F.lag("close", k).over(t)), jump)
    six = t.rowsBetween(-LOOKBACK, Window.currentRow)
    rows = rows.withColumns(jumps | {"run_start": F.lag("ts", LOOKBACK).over(t), "run_spot": F.lag("spot_close", LOOKBACK).over(t), "run_low": F.min("low").over(six), "run_high": F.max("high").over(six)})
    found = _otm(rows.where(is_green()).withColumn("__v", F.greatest("__j1", "__j2")).where("__v is not null"))
    return _shape(
        found, "otm_wall", pattern_start=F.col("run_start"), seq_length=F.lit(LOOKBACK), dist=half_up(F.col("dist"), 4), log_value=half_up(F.col("wall_value"), 3),
        log_jump=half_up(F.col("__v"), 3), pattern_high=F.col("run_high"), pattern_low=half_up(F.col("run_low"), 4),
        spot_price=half_up(F.col("spot_close"), 3), distance_pct=_distance(), signal_value=half_up(F.col("__v"), 3),
    )


@dataclass(frozen=True)
class Detector:
    """A pattern: how to find it, whether it needs spot, whether its payoff counts out-of-the-money options alone."""

    compute: Callable[..., DataFrame]
    requires_spot: bool
    otm_only: bool


REGISTRY: dict[str, Detector] = {
    "red_squeeze": Detector(detect_red_squeeze, False, False),
    "otm_red_squeeze": Detector(detect_otm_red_squeeze, True, True),
    "green_stairs": Detector(detect_green_stairs, True, True),
    "otm_wall": Detector(detect_otm_wall, True, True),
}


def select_detectors(ids: list[str] | None = None) -> dict[str, Detector]:
    """Detectors by id, all by default; unknown ids are refused."""
    if unknown := set(ids or ()) - set(REGISTRY):
        raise KeyError(f"no detector {sorted(unknown)}; there are {sorted(REGISTRY)}")
    return {k: REGISTRY[k] for k in ids or REGISTRY}


def run_detectors(candles: DataFrame, spot: DataFrame | None, ids: list[str] | None = None, min_values: dict[str, float] | None = None) -> DataFrame:
    """All firings of the detectors with their outcomes. Those that need spot are skipped where there is none.

    Candles that have spot_close already (with_spot_bar) are looked up no more, and their firings keep spot_bar.
    """
    parts, seen = [], spot is not None or "spot_close" in candles.columns
    for name, d in select_detectors(ids).items():
        if d.requires_spot and not seen:
            continue
        how = {"min_value": (min_values or {})[name]} if name in (min_values or {}) else {}
        parts.append(d.compute(candles, spot, **how))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return annotate_outcomes(out)
