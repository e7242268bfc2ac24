"""The chain-wide run: every detector over every series, outcomes, filters, payoffs and merged events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.functions.candles import with_instrument_cols
from wickwork.functions.scalars import half_up
from wickwork.operators.asof import spot_for_duration, with_spot_bar
from wickwork.operators.detect import run_detectors, select_detectors
from wickwork.operators.filters import apply_firing_cutoff, apply_opposite_filter
from wickwork.operators.guarded import register_outcomes
from wickwork.operators.merge import merge_events
from wickwork.operators.outcomes import with_peak_after
from wickwork.operators.rollup import trim_dte
from wickwork.operators.settlement import tte_hours
from wickwork.operators.universe import universe_max
from wickwork.sources.scratch import cut


def prepared(candles: DataFrame, spot: DataFrame, settlements: DataFrame, durations: list[int] | None = None, windows: dict[int, float] | None = None) -> DataFrame:
    """Bars inside their duration's window before settlement, each with settle_ts, what comes after it and the spot bar of its duration.

    `durations` are those of `candles`, a configured list; without it they are looked up.
    """
    known = candles.join(settlements.select("spot", "expiry", "settle_ts"), ["spot", "expiry"], "left")
    bars = cut(with_peak_after(trim_dte(known, windows=windows)), "bars")
    if durations is None:
        durations = [r["duration"] for r in bars.select("duration").distinct().orderBy("duration").collect()]
    if not durations:
        return with_spot_bar(bars, spot)
    return cut(with_spot_bar(bars, spot_for_duration(spot, durations)), "spotted")


def run_signals(
    candles: DataFrame, spot: DataFrame, settlements: DataFrame, ids: list[str] | None = None, min_values: dict[str, float] | None = None,
    mode: str = "all_same_type", cutoff: float = 1.5, durations: list[int] | None = None, windows: dict[int, float] | None = None,
) -> DataFrame:
    """Firings that pass the cutoff and the opposite-direction filter, with settle_ts and the universe's best payoff.

    Bars are prepared once; firings are few beside them and are written once.
    """
    bars = prepared(candles, spot, settlements, durations, windows)
    found = run_detectors(bars, None, ids, min_values).join(settlements.select("spot", "expiry", "settle_ts"), ["spot", "expiry"], "left")
    kept = cut(apply_opposite_filter(apply_firing_cutoff(found, cutoff)).drop("spot_bar"), "firings")
    detectors = select_detectors(ids)
    parts = []
    for otm in (False, True):
        if mine := [k for k, d in detectors.items() if d.otm_only == otm]:
            parts.append(universe_max(kept.where(F.col("signal").isin(*mine)), bars, None, mode, otm))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_events(candles: DataFrame, spot: DataFrame, settlements: DataFrame, **how) -> DataFrame:
    """The run's firings merged into events, with settle_ts."""
    merged = merge_events(run_signals(candles, spot, settlements, **how))
    return merged.join(settlements.select("spot", "expiry", "settle_ts"), ["spot", "expiry"], "left")


def to_pattern_rows(signals: DataFrame) -> DataFrame:
    """Flat rows for queries: hours to settlement from the pattern's start and from the entry, moneyness and cheapness. Outcome fields are marked."""
    named = with_instrument_cols(signals).withColumnRenamed("opt_type", "type")
    rows = named.withColumns(
        {
            "tte_hours": half_up(tte_hours("pattern_start"), 2), "entry_tte_hours": half_up(tte_hours("entry_ts"), 2),
            "otm": F.when(F.col("distance_pct").isNotNull(), F.col("distance_pct") > 0),
            "cheapness": F.try_divide("spot_price", F.when(F.col("avg_price") != 0, F.col("avg_price"))),
        }
    )
    if "univ_ratio" in rows.columns:
        rows = rows.withColumn("univ_ratio", F.coalesce("univ_ratio", "ratio"))
    return register_outcomes(rows.drop("opt_spot", "code", "trigger_high", "settle_ts"))


def extract_patterns(candles: DataFrame, spot: DataFrame, settlements: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Every structural match, no threshold applied, as pattern rows. The wall keeps its jump rule, which is its structure."""
    floors = {k: 0.0 for k in select_detectors(ids) if k != "otm_wall"}
    return to_pattern_rows(run_signals(candles, spot, settlements, ids, floors))
