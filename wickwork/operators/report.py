"""Hit-rate reports, summaries, calendars, grids and heatmaps over events and trades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickwork.functions.bands import MIN_SAMPLE, RATIO_BANDS, THRESHOLDS, band_range, strength_bands
from wickwork.functions.scalars import half_up
from wickwork.functions.timegrid import ist
from wickwork.operators.filters import payoff


def _hits(ratio: Column, thresholds: tuple) -> list[Column]:
    return [F.count_if(ratio >= t).alias(f"hit_{t}x") for t in thresholds]


def _pct(df: DataFrame, thresholds: tuple) -> DataFrame:
    """pct_{t}x to 1 place; 0 for empty cells."""
    share = lambda t: F.when(F.col("n") > 0, half_up(F.col(f"hit_{t}x") * 100.0 / F.col("n"), 1)).otherwise(0.0)
    return df.withColumns({f"pct_{t}x": share(t) for t in thresholds})


def quality(events: DataFrame, by: list[str], source: str = "fired", thresholds: tuple = THRESHOLDS) -> DataFrame:
    """n, states, and the number and share that reach each threshold, per `by`."""
    state = lambda s: F.count_if(F.col("state") == s).alias(s)
    grouped = events.groupBy(*by).agg(F.count("*").alias("n"), state("activated"), state("slHit"), state("pending"), *_hits(payoff(source), thresholds))
    return _pct(grouped, thresholds)


def complete_axis(agg: DataFrame, dims: list[DataFrame]) -> DataFrame:
    """Every combination of the axes' first columns; counts are 0 where the aggregate has no row. Axes are short configured lists."""
    axis = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), dims)
    keys = [d.columns[0] for d in dims]
    counts = [c for c in agg.columns if c not in keys]
    return axis.join(agg, keys, "left").na.fill(0, counts)


def _best(df: DataFrame, threshold: int, min_sample: int = MIN_SAMPLE) -> DataFrame:
    """thin (under min_sample) and best: the highest share among cells that are not thin."""
    share = F.when(F.col("n") >= min_sample, F.col(f"pct_{threshold}x"))
    # The axes are configured lists, so the cells are few.
    top = F.max(share).over(Window.partitionBy(F.lit(1)))
    return df.withColumns({"thin": F.col("n") < min_sample, "best": F.coalesce((share == top) & (top > 0), F.lit(False))})


def breakdown(tagged: DataFrame, dims: list[DataFrame], source: str = "fired", threshold: int = 10, thresholds: tuple = THRESHOLDS, min_sample: int = MIN_SAMPLE) -> DataFrame:
    """Hit rates over one to three axes, each cell of the full axes, with thin and best marks. Each axis is named by its first column."""
    keys = [d.columns[0] for d in dims]
    rows = tagged.groupBy(*keys).agg(F.count("*").alias("n"), *_hits(payoff(source), thresholds))
    return _best(_pct(complete_axis(rows, dims), thresholds), threshold, min_sample)


def breakdown_best_each(tagged: DataFrame, dim: DataFrame, source: str = "fired", thresholds: tuple = THRESHOLDS, min_sample: int = MIN_SAMPLE) -> DataFrame:
    """One axis with the best bucket of every threshold marked."""
    key = dim.columns[0]
    rows = tagged.groupBy(key).agg(F.count("*").alias("n"), *_hits(payoff(source), thresholds))
    out = _pct(complete_axis(rows, [dim]), thresholds)
    w = Window.partitionBy(F.lit(1))
    marks = {}
    for t in thresholds:
        share = F.when(F.col("n") >= min_sample, F.col(f"pct_{t}x"))
        marks[f"best_{t}x"] = F.coalesce((share == F.max(share).over(w)) & (share > 0), F.lit(False))
    return out.withColumns(marks)


def cross_tab(tagged: DataFrame, a: DataFrame, b: DataFrame, source: str = "fired", threshold: int = 10, min_sample: int = MIN_SAMPLE) -> DataFrame:
    """Hit rate and n of each cell of two axes."""
    return breakdown(tagged, [a, b], source, threshold, (threshold,), min_sample)


def heat_matrix(events: DataFrame, signal: str) -> DataFrame:
    """Strength band by ratio band: counts for the fired and the universe payoff, with row totals."""
    strength, ratios = strength_bands(signal), range(len(RATIO_BANDS))
    rows = events.where(F.col("signal") == signal).select(band_range(F.col("max_value"), strength).alias("strength"), band_range(payoff("fired"), RATIO_BANDS).alias("f"), band_range(payoff("universe"), RATIO_BANDS).alias("u"))
    cells = [F.count_if(F.col(k) == i).alias(f"{name}_{i}") for k, name in (("f", "fired"), ("u", "universe")) for i in ratios]
    axis = events.sparkSession.createDataFrame([(i, b[0]) for i, b in enumerate(strength)], "strength int, label string")
    return complete_axis(rows.groupBy("strength").agg(F.count("*").alias("total"), *cells), [axis])


def cumulative_matrix(events: DataFrame, signal: str, thresholds: tuple = THRESHOLDS, source: str = "fired") -> DataFrame:
    """Share of each strength band that reaches at least each threshold."""
    bands = strength_bands(signal)
    rows = events.where(F.col("signal") == signal).withColumn("strength", band_range(F.col("max_value"), bands))
    axis = events.sparkSession.createDataFrame([(i, b[0]) for i, b in enumerate(bands)], "strength int, label string")
    return _pct(complete_axis(rows.groupBy("strength").agg(F.count("*").alias("n"), *_hits(payoff(source), thresholds)), [axis]), thresholds)


def decorate_events(events: DataFrame, signal: str, min_ratio: float = 0.0, min_strength: float = 0.0, kind: str | None = None) -> DataFrame:
    """Events of a signal with their strength, fired-ratio and universe-ratio bands, the best first."""
    rows = events.where((F.col("signal") == signal) & (F.col("max_ratio") >= min_ratio) & (F.col("max_value") >= min_strength))
    if kind:
        rows = rows.where(F.col("type") == kind)
    made = {"strength_band": band_range(F.col("max_value"), strength_bands(signal)), "fired_band": band_range(payoff("fired"), RATIO_BANDS), "univ_band": band_range(payoff("universe"), RATIO_BANDS)}
    return rows.withColumns(made).orderBy(F.desc("max_ratio"), "start_ts", "duration", "type")


def hit_tree(events: DataFrame, thresholds: tuple = THRESHOLDS) -> DataFrame:
    """Counts and hits of both payoffs per (duration, expiry), per duration and in all; null keys stand for totals."""
    fired = [F.count_if(payoff("fired") >= t).alias(f"fired_{t}x") for t in thresholds]
    universe = [F.count_if(payoff("universe") >= t).alias(f"universe_{t}x") for t in thresholds]
    return events.rollup("duration", "expiry").agg(F.count("*").alias("n"), *fired, *universe).where("n > 0")


def expiry_duration_grid(events: DataFrame, threshold: float, durations: list[int], source: str = "fired", hide_empty: bool = False, sort: str = "expiry") -> DataFrame:
    """Hits per expiry, one column a duration, with the row's hits and events; sorted by expiry or by hits."""
    hit = payoff(source) >= threshold
    cells = [F.count_if(hit & (F.col("duration") == d)).alias(f"d{d}") for d in durations]
    grid = events.groupBy("expiry").agg(*cells, F.count_if(hit).alias("hits"), F.count("*").alias("n"))
    grid = grid.where("hits > 0") if hide_empty else grid
    return grid.orderBy(*([F.desc("hits"), "expiry"] if sort == "hits" else ["expiry"]))


def expiry_summary(events: DataFrame) -> DataFrame:
    """Per signal and expiry: durations, and per side counts and best payoffs of both kinds."""
    side = lambda k, c: F.coalesce(F.max(F.when(F.col("type") == k, c)), F.lit(0.0))
    return events.groupBy("signal", "spot", "expiry").agg(
        F.sort_array(F.collect_set("duration")).alias("durations"), F.count_if(F.col("type") == "C").alias("calls"), F.count_if(F.col("type") == "P").alias("puts"),
        side("C", payoff("fired")).alias("best_call"), side("P", payoff("fired")).alias("best_put"), side("C", payoff("universe")).alias("univ_call"), side("P", payoff("universe")).alias("univ_put"),
    )


def trade_summary(trade_events: DataFrame) -> DataFrame:
    """Per expiry: best ratio and count of each side, and the durations."""
    side = lambda k: F.coalesce(F.max(F.when(F.col("type") == k, F.col("max_ratio"))), F.lit(0.0))
    return trade_events.groupBy("spot", "expiry").agg(
        side("C").alias("best_call"), side("P").alias("best_put"), F.count_if(F.col("type") == "C").alias("calls"), F.count_if(F.col("type") == "P").alias("puts"),
        F.sort_array(F.collect_set("duration")).alias("durations"),
    )


def calendar(summary: DataFrame, day: str = "expiry") -> DataFrame:
    """One row per day from the first to the last expiry, with month, weekday (Monday 0) and the summary's columns where it has the day."""
    span = summary.agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a is not null")
    days = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    rows = days.join(summary.withColumn("day", F.col(day)).drop(day), "day", "left")
    return rows.withColumns({"month": F.date_format("day", "yyyy-MM"), "weekday": F.weekday("day")})


def expiry_panels(events: DataFrame, source: str = "fired") -> DataFrame:
    """Per expiry, duration and side the best payoff and count; panels of a side ranked by their own best."""
    rows = events.groupBy("expiry", "duration", "type").agg(F.max(payoff(source)).alias("best"), F.count("*").alias("n"))
    return rows.withColumn("rank", F.rank().over(Window.partitionBy("expiry", "type").orderBy(F.desc("best"))))


def panel_events(events: DataFrame, limit: int = 300) -> DataFrame:
    """The best `limit` events of each panel."""
    k = F.row_number().over(Window.partitionBy("expiry", "duration", "type").orderBy(F.desc("max_ratio"), "start_ts"))
    return events.withColumn("nth", k).where(F.col("nth") <= limit)


def best_trade_summary(trades: DataFrame, min_ratio: float = 5.0, thresholds: tuple = THRESHOLDS) -> DataFrame:
    """Per expiry, and in all (null keys): instruments scanned, those that qualify, hits and the best row."""
    best = F.max(F.struct(F.col("ratio"), F.col("symbol")))
    rows = trades.rollup("spot", "expiry").agg(F.count("*").alias("scanned"), F.count_if(F.col("ratio") >= min_ratio).alias("qualifying"), *_hits(F.col("ratio"), thresholds), best.alias("b"))
    return rows.where("spot is null or expiry is not null").withColumns({"best_ratio": F.col("b.ratio"), "best_symbol": F.col("b.symbol")}).drop("b")


def best_trades_sorted(trades: DataFrame, by: str = "ratio", descending: bool = True, limit: int = 1000) -> DataFrame:
    """The first `limit` trades in any order."""
    return trades.orderBy(F.desc(by) if descending else F.asc(by), "spot", "expiry", "symbol").limit(limit)


def heatmap(events: DataFrame, alive: DataFrame, at: Column, duration: int, kind: str, slots: int, min_value: float = 0.0, names: int = 14) -> DataFrame:
    """Alive expiries by the last `slots` slots: distinct symbols that fired with their event's end in the slot, and up to `names` of them."""
    size = duration * 60
    last = F.floor((F.unix_seconds(at) - 43_200) / size) * size + 43_200
    axis = alive.select("spot", "expiry").withColumn("slot", F.explode(F.sequence(last - (slots - 1) * size, last, F.lit(size).cast("bigint"))))
    fired = events.where((F.col("duration") == duration) & (F.col("type") == kind) & (F.col("max_value") >= min_value) & (F.col("end_ts") <= at))
    each = fired.select("spot", "expiry", (F.floor((F.unix_seconds("end_ts") - 43_200) / size) * size + 43_200).alias("slot"), F.explode("instruments").alias("symbol"))
    cells = each.groupBy("spot", "expiry", "slot").agg(F.count_distinct("symbol").alias("fired"), F.slice(F.sort_array(F.collect_set("symbol")), 1, names).alias("names"))
    out = axis.join(cells, ["spot", "expiry", "slot"], "left")
    return out.withColumns({"fired": F.coalesce("fired", F.lit(0)), "names": F.coalesce("names", F.array().cast("array<string>"))})


def heatmap_at(events: DataFrame, alive: DataFrame, duration: int, kind: str, slots: int, min_value: float = 0.0, names: int = 14) -> DataFrame:
    """heatmap for each moment of `alive` (alive_at), with the columns of `heatmap` and at.

    A slot that is over counts the same at every later moment; only of the slot
    that a moment lies in are the events after it left out.
    """
    size = duration * 60
    slot_of = lambda c: F.floor((F.unix_seconds(c) - 43_200) / size) * size + 43_200
    last = slot_of("at")
    axis = alive.select("spot", "expiry", "at").withColumn("slot", F.explode(F.sequence(last - (slots - 1) * size, last, F.lit(size).cast("bigint"))))
    fired = events.where((F.col("duration") == duration) & (F.col("type") == kind) & (F.col("max_value") >= min_value))
    each = fired.select("spot", "expiry", slot_of("end_ts").alias("slot"), "end_ts", F.explode("instruments").alias("symbol"))
    # The first time a symbol fires in a slot decides at which moments it is there.
    each = each.groupBy("spot", "expiry", "slot", "symbol").agg(F.min("end_ts").alias("__first"))
    keys = ["spot", "expiry", "slot"]
    hits = axis.join(each, keys).where("__first <= at").groupBy(*keys, "at").agg(F.count("*").alias("fired"), F.slice(F.sort_array(F.collect_list("symbol")), 1, names).alias("names"))
    out = axis.join(hits, [*keys, "at"], "left")
    return out.withColumns({"fired": F.coalesce("fired", F.lit(0)), "names": F.coalesce("names", F.array().cast("array<string>"))})


def heatmap_totals(cells: DataFrame) -> DataFrame:
    return cells.agg(F.max("fired").alias("most"), F.sum("fired").alias("total"))


def silent_durations(events: DataFrame, durations: list[int]) -> DataFrame:
    """Configured durations without any firing."""
    axis = events.sparkSession.createDataFrame([(d,) for d in durations], "duration int")
    return axis.join(events.select("duration").distinct(), "duration", "left_anti")


def timeline(events: DataFrame) -> DataFrame:
    """Distinct ends of events with the least and the greatest strength there."""
    return events.groupBy("end_ts").agg(F.min("max_value").alias("least"), F.max("max_value").alias("most"), F.count("*").alias("n"))


def timeline_days(events: DataFrame) -> DataFrame:
    """Firings per local day."""
    return events.groupBy(F.to_date(ist("end_ts")).alias("day")).agg(F.count("*").alias("n"))
