"""The registered queries: each reads the given tables and returns plain columns (times as epoch seconds, dates as text)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wickwork.functions import bands
from wickwork.functions.candles import SERIES, distance_pct, is_otm, with_instrument_cols
from wickwork.functions.scalars import FUNCTIONS, half_up
from wickwork.functions.timegrid import ist_string, with_entry_time
from wickwork.operators import detect, filters, guarded, indicators, merge, moneyness, report, settlement, trades, universe, walkforward, work
from wickwork.operators.asof import latest_spot, require_spot, spot_for_duration, with_spot
from wickwork.operators.outcomes import annotate_outcomes, with_peak_after
from wickwork.operators.rollup import gapless, rollup_many, strip_warmup, ticks_to_candles, trim_dte
from wickwork.plans import views
from wickwork.plans.run import extract_patterns, run_events, run_signals, to_pattern_rows
from wickwork.sources import candles as candle_tables
from wickwork.sources import instruments as listed
from wickwork.sources import results as result_tables
from wickwork.sources import tables
from wickwork.sources.candles import newest_bars
from wickwork.sources.scratch import cut, fresh

#: Thresholds that suit the prices of the given tables.
FLOORS = {"red_squeeze": 0.0, "otm_red_squeeze": 0.0, "green_stairs": 0.0, "otm_wall": 0.3}
THRESHOLDS, MIN_SAMPLE = (2, 5, 10), 3
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def _plain(df: DataFrame) -> DataFrame:
    """Times as epoch seconds, dates as text, arrays of text joined by commas."""
    made = {}
    for f in df.schema:
        kind = f.dataType.simpleString()
        if kind == "timestamp":
            made[f.name] = F.unix_seconds(f.name)
        elif kind == "date":
            made[f.name] = F.col(f.name).cast("string")
        elif kind in ("array<string>", "array<int>"):
            made[f.name] = F.array_join(F.col(f.name).cast("array<string>"), ",")
    return df.withColumns(made) if made else df


def _now() -> Column:
    """A moment inside the tables' span: 2024-01-16 12:00 UTC."""
    return F.timestamp_seconds(F.lit(1_705_406_400))


def _base(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bars, spot and settlements. The bars are written: settlements and every later step read them."""
    bars = cut(views.chain_bars(spark, d), "chain")
    return bars, views.spot_bars(spark, d), views.expiries(bars)


def _signals(spark: SparkSession, d: str, **how) -> DataFrame:
    bars, spot, settle = _base(spark, d)
    return run_signals(bars, spot, settle, min_values=FLOORS, durations=[120], **how)


def _events(spark: SparkSession, d: str) -> DataFrame:
    bars, spot, settle = _base(spark, d)
    return run_events(bars, spot, settle, min_values=FLOORS, durations=[120])


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    bars, spot, settle = _base(spark, d)
    events = cut(run_events(bars, spot, settle, min_values=FLOORS, durations=[120]), "events")
    return moneyness.tag_events(events, cut(spot, "spot"))


# Candles


@query
def ohlcv_60m(spark, d):
    return _plain(ticks_to_candles(views.ticks(spark, d), 60, ["symbol"]).drop("duration"))


@query
def ohlcv_multi(spark, d):
    fine = ticks_to_candles(views.ticks(spark, d), 30, ["symbol"])
    return _plain(rollup_many(fine, [60, 90, 240, 1440], ["symbol"], (30,)))


@query
def daily_bars_supplier(spark, d):
    return _plain(views.supplier_bars(spark, d).drop("spot", "expiry", "duration"))


@query
def chain_candles(spark, d):
    return _plain(views.chain_bars(spark, d).drop("spot", "duration"))


@query
def warmup_strip(spark, d):
    return _plain(strip_warmup(views.chain_bars(spark, d)).select("symbol", "expiry", "ts", "close"))


@query
def dte_trim(spark, d):
    bars, _, settle = _base(spark, d)
    return _plain(trim_dte(bars.join(settle, ["spot", "expiry"]), windows={120: 24}).select("symbol", "expiry", "ts", "close"))


@query
def peak_after(spark, d):
    return _plain(with_peak_after(views.chain_bars(spark, d)).select("symbol", "expiry", "ts", "peak_after", "peak_bars"))


@query
def supplier_peak_after(spark, d):
    return _plain(with_peak_after(views.supplier_series(spark, d)).select("symbol", "ts", "close", "peak_after"))


# Joins in time


@query
def asof_spot(spark, d):
    hourly = views.spot_bars(spark, d, 60).withColumn("ts", F.timestamp_seconds(F.unix_seconds("ts") + 1800))
    return _plain(with_spot(views.chain_bars(spark, d).select("spot", "symbol", "expiry", "ts"), hourly, per=("spot",)).drop("spot"))


@query
def moneyness_at_bar(spark, d):
    rows = with_instrument_cols(with_spot(views.chain_bars(spark, d), views.spot_bars(spark, d)))
    kind, strike, price = F.col("opt_type"), F.col("strike"), F.col("spot_close")
    return _plain(rows.select("symbol", "expiry", "ts", is_otm(kind, strike, price).alias("otm"), distance_pct(kind, strike, price).alias("distance_pct")))


@query
def spot_series(spark, d):
    base = views.spot_bars(spark, d, 30).unionByName(views.spot_bars(spark, d, 60))
    return _plain(spot_for_duration(base, [90, 120]).drop("spot"))


@query
def latest_spot_close(spark, d):
    return latest_spot(views.spot_bars(spark, d, 60).unionByName(views.spot_bars(spark, d, 30)))


# Detectors

SHOWN = ["symbol", "expiry", "entry_ts", "entry_price", "pattern_start", "seq_length", "first_body", "last_body", "trigger_body", "pattern_low", "ratio1", "ratio2", "signal_value", "trigger_price", "state", "ratio"]


def _detected(spark, d, name, *more):
    bars, spot, _ = _base(spark, d)
    found = detect.run_detectors(with_peak_after(bars), spot, [name], FLOORS)
    return _plain(found.select(*SHOWN, *more))


@query
def red_squeeze(spark, d):
    return _detected(spark, d, "red_squeeze")


@query
def otm_red_squeeze(spark, d):
    return _detected(spark, d, "otm_red_squeeze", "pattern_high", "avg_price", "spot_price", "distance_pct")


@query
def green_stairs(spark, d):
    return _detected(spark, d, "green_stairs", "equal_steps", "pattern_high", "avg_price")


@query
def otm_wall(spark, d):
    bars, spot, _ = _base(spark, d)
    found = detect.run_detectors(with_peak_after(bars), spot, ["otm_wall"], FLOORS)
    return _plain(found.select("symbol", "expiry", "entry_ts", "pattern_start", "dist", "log_value", "signal_value", "pattern_high", "pattern_low", "state", "ratio"))


@query
def supplier_squeeze(spark, d):
    found = annotate_outcomes(detect.detect_red_squeeze(with_peak_after(gapless(views.supplier_series(spark, d))), min_value=2.0))
    return _plain(found.select("symbol", "entry_ts", "pattern_start", "seq_length", "signal_value", "state", "ratio"))


@query
def outcomes(spark, d):
    return _plain(_signals(spark, d).select("signal", "symbol", "expiry", "entry_ts", "trigger_price", "peak_after", "ratio", "state", "broke_out", "hold_candles"))


@query
def firing_cutoff(spark, d):
    bars, _, settle = _base(spark, d)
    found = annotate_outcomes(detect.detect_red_squeeze(with_peak_after(bars), min_value=0.0)).join(settle, ["spot", "expiry"])
    return _plain(filters.apply_firing_cutoff(found, 24.0).select("symbol", "expiry", "entry_ts", "ratio"))


@query
def opposite_filter(spark, d):
    bars, spot, _ = _base(spark, d)
    found = annotate_outcomes(detect.detect_red_squeeze(with_peak_after(bars), min_value=0.0))
    return _plain(filters.apply_opposite_filter(found, spot, 0.3).select("symbol", "expiry", "entry_ts", "ratio"))


# Universe


def _universe(spark, d, mode, otm):
    bars, spot, _ = _base(spark, d)
    bars = cut(with_peak_after(bars), "bars")
    found = detect.detect_red_squeeze(bars, min_value=0.0)
    return _plain(universe.universe_max(found, bars, spot, mode, otm).select("symbol", "expiry", "entry_ts", "univ_ratio", "univ_symbol"))


@query
def universe_max(spark, d):
    return _universe(spark, d, "all_same_type", False)


@query
def universe_further_otm(spark, d):
    return _universe(spark, d, "further_otm", False)


@query
def universe_otm(spark, d):
    return _universe(spark, d, "all_same_type", True)


# Events and reports


@query
def merge_events(spark, d):
    return _plain(_events(spark, d).drop("spot", "settle_ts"))


@query
def quality_by_type(spark, d):
    return report.quality(_events(spark, d), ["signal", "type"], "universe", THRESHOLDS)


@query
def breakdown_tte(spark, d):
    axis = bands.dim(spark, bands.TTE_BUCKETS, "tte")
    return report.breakdown_best_each(_tagged(spark, d), axis, "fired", THRESHOLDS, MIN_SAMPLE)


@query
def crosstab_tte_moneyness(spark, d):
    tagged, _ = moneyness.tagged_and_excluded(_tagged(spark, d))
    axes = [bands.dim(spark, bands.TTE_BUCKETS, "tte"), bands.dim(spark, bands.MONEYNESS_BUCKETS, "moneyness_bucket")]
    return report.cross_tab(tagged, *axes, "universe", 10, MIN_SAMPLE)


@query
def breakdown3(spark, d):
    types = spark.createDataFrame([("C",), ("P",)], "type string")
    signals = spark.createDataFrame([(k,) for k in FLOORS], "signal string")
    axes = [signals, types, bands.dim(spark, bands.TTE_BUCKETS, "tte")]
    return report.breakdown(_tagged(spark, d), axes, "universe", 5, THRESHOLDS, MIN_SAMPLE)


@query
def moneyness_excluded(spark, d):
    return moneyness.tagged_and_excluded(_tagged(spark, d))[1]


@query
def event_moneyness(spark, d):
    tagged = _tagged(spark, d)
    return _plain(tagged.select("signal", "expiry", "type", "start_ts", half_up(F.col("moneyness"), 6).alias("moneyness"), "moneyness_bucket", "tte"))


@query
def heat_matrix(spark, d):
    return report.heat_matrix(_events(spark, d), "red_squeeze")


@query
def cumulative_matrix(spark, d):
    return report.cumulative_matrix(_events(spark, d), "otm_wall", THRESHOLDS)


@query
def hit_tree(spark, d):
    return _plain(report.hit_tree(_events(spark, d), THRESHOLDS))


@query
def expiry_grid(spark, d):
    return _plain(report.expiry_duration_grid(_events(spark, d), 2, [60, 120], sort="hits"))


@query
def expiry_summary(spark, d):
    return _plain(report.expiry_summary(_events(spark, d)))


@query
def calendar(spark, d):
    summary = report.expiry_summary(_events(spark, d).where("signal = 'otm_wall'")).select("expiry", "calls", "puts", "best_call")
    return _plain(report.calendar(summary))


@query
def panels(spark, d):
    return _plain(report.expiry_panels(_events(spark, d)))


@query
def panel_events(spark, d):
    rows = report.panel_events(_events(spark, d).where("signal = 'otm_wall'"), 5)
    return _plain(rows.select("expiry", "type", "start_ts", "max_ratio", "nth"))


@query
def decorated(spark, d):
    rows = report.decorate_events(_events(spark, d), "red_squeeze", 1.0, 2.0)
    return _plain(rows.select("expiry", "type", "start_ts", "max_ratio", "strength_band", "fired_band", "univ_band"))


@query
def calibrated(spark, d):
    events = filters.calibrate(_events(spark, d).where("signal = 'otm_wall'"), 0.4, 1.5, 2, 120, "C")
    return walkforward.evaluate(events, filters.payoff("universe") >= 10)


@query
def alive_expiries(spark, d):
    bars, _, settle = _base(spark, d)
    return _plain(settlement.alive_expiries(settle, bars, _now()).select("expiry", "listed_ts"))


@query
def heatmap(spark, d):
    bars, spot, settle = _base(spark, d)
    events = run_events(bars, spot, settle, min_values=FLOORS, durations=[120]).where("signal = 'otm_wall'")
    alive = settlement.alive_expiries(settle, bars, _now())
    return _plain(report.heatmap(events, alive, _now(), 120, "C", 36).drop("spot"))


@query
def timeline(spark, d):
    return _plain(report.timeline(_events(spark, d)))


@query
def silent_durations(spark, d):
    return report.silent_durations(_events(spark, d), [60, 120, 240])


# Pattern rows and guarded conditions


@query
def pattern_rows(spark, d):
    rows = to_pattern_rows(_signals(spark, d))
    return _plain(rows.select("signal", "symbol", "type", "strike", "expiry", "entry_ts", "tte_hours", "entry_tte_hours", "otm", "distance_pct", "signal_value", half_up(F.col("cheapness"), 4).alias("cheapness"), "univ_ratio"))


@query
def entry_times(spark, d):
    rows = with_entry_time(to_pattern_rows(_signals(spark, d)))
    return _plain(rows.select("signal", "symbol", "expiry", "entry_ts", ist_string("entry_ts").alias("entry"), "entry_hour", "entry_minute", "entry_weekday", "entry_date"))


@query
def ex_ante_filter(spark, d):
    rows = to_pattern_rows(_signals(spark, d))
    kept = guarded.where_ex_ante(rows, "tte_hours between 12 and 60 and distance_pct > -20 and signal_value >= 0.2")
    return _plain(kept.select("signal", "symbol", "expiry", "entry_ts"))


@query
def derived_cols(spark, d):
    rows = guarded.with_derived(to_pattern_rows(_signals(spark, d)), [("span", "pattern_high - pattern_low"), ("rel", "coalesce(try_divide(span, entry_price), 0)"), ("gain", "ratio - 1")])
    kept = guarded.mark_success(guarded.where_ex_ante(rows, "rel > 0.5"), "gain > 0")
    return _plain(kept.select("signal", "symbol", "expiry", "entry_ts", half_up(F.col("rel"), 4).alias("rel"), "win"))


@query
def unpopulated_fields(spark, d):
    bars, spot, settle = _base(spark, d)
    rows = extract_patterns(bars, spot, settle, ["red_squeeze"])
    return guarded.unpopulated_fields(rows, ["distance_pct", "equal_steps", "signal_value", "tte_hours", "dist"])


def _units(spark, d):
    rows = to_pattern_rows(_signals(spark, d)).where("signal = 'otm_wall'")
    return cut(merge.merge_rows(guarded.mark_success(rows, "ratio >= 2")), "units")


@query
def merged_units(spark, d):
    return _plain(_units(spark, d).select("expiry", "duration", "type", "start_ts", "end_ts", "n", "symbol", "ratio", "univ_ratio", "win", "instruments"))


@query
def folds(spark, d):
    return _plain(walkforward.build_folds(views.chain_bars(spark, d)))


def _walk(spark, d):
    units = _units(spark, d)
    return walkforward.walk_forward(walkforward.fold_side(units, walkforward.build_folds(units)), MIN_SAMPLE)


@query
def walk_forward(spark, d):
    return _plain(_walk(spark, d))


@query
def oos_summary(spark, d):
    return walkforward.oos_summary(_walk(spark, d))


@query
def top_units(spark, d):
    return _plain(walkforward.top_units(_units(spark, d), limit=20, symbols=3).select("win", "nth", "expiry", "type", "symbol", "ratio", "instruments"))


# Trades


def _best(spark, d):
    return trades.best_trade(trades.finest(views.chain_bars(spark, d)))


@query
def best_trade(spark, d):
    return _plain(_best(spark, d).drop("spot", "duration"))


@query
def best_trade_summary(spark, d):
    return _plain(report.best_trade_summary(_best(spark, d), 5.0, THRESHOLDS))


@query
def best_trade_moneyness(spark, d):
    rows = trades.trade_moneyness(_best(spark, d), views.spot_bars(spark, d), "entry_ts", "symbol")
    return _plain(filters.filter_best_trades(rows, 5.0, "C", True).select("symbol", "expiry", "ratio", "spot_at_entry", "entry_distance"))


@query
def best_trades_top(spark, d):
    return _plain(report.best_trades_sorted(_best(spark, d), "hold_candles", True, 50).select("expiry", "symbol", "ratio", "hold_candles"))


def _trades(spark, d):
    return trades.find_trades(views.chain_bars(spark, d), min_ratio=2.0)


@query
def find_trades(spark, d):
    return _plain(_trades(spark, d).drop("spot", "duration"))


def _trade_events(spark, d):
    typed = with_instrument_cols(_trades(spark, d)).withColumnRenamed("opt_type", "type").select(*SERIES, "type", "low_ts", "high_ts", "low_price", "high_price", "hold_candles", "ratio")
    return merge.merge_trades(typed)


@query
def merge_trades(spark, d):
    rows = _trade_events(spark, d)
    return _plain(rows.withColumn("instruments", F.transform("instruments", lambda x: x["symbol"])).drop("spot", "duration"))


@query
def trade_summary(spark, d):
    return _plain(report.trade_summary(_trade_events(spark, d)))


@query
def trade_scan(spark, d):
    found = cut(trades.find_trades(views.chain_bars(spark, d), min_ratio=0.0), "trades")
    return _plain(trades.scan_stats(views.chain_bars(spark, d), found, 5.0))


# Indicators


@query
def ema_spread(spark, d):
    rows = indicators.ema_spread(views.chain_bars(spark, d), (5, 10))
    return _plain(rows.select("symbol", "expiry", "ts", half_up(F.col("ema5"), 4).alias("ema5"), half_up(F.col("ema10"), 4).alias("ema10"), half_up(F.col("spread_pct"), 3).alias("spread_pct")))


@query
def price_volatility(spark, d):
    return _plain(indicators.price_volatility(views.chain_bars(spark, d)).select("symbol", "expiry", "ts", half_up(F.col("vol5"), 4).alias("vol5"), half_up(F.col("vol10"), 4).alias("vol10")))


@query
def volatility_board(spark, d):
    rows = indicators.volatility_board(views.chain_bars(spark, d), views.spot_bars(spark, d, 60))
    return _plain(rows.select("symbol", "expiry", "ts", "strike", "opt_type", half_up(F.col("vol5"), 4).alias("vol5"), "otm"))


@query
def atm_strike(spark, d):
    board = indicators.volatility_board(views.chain_bars(spark, d), views.spot_bars(spark, d, 60))
    return _plain(indicators.atm_strike(board).drop("spot", "duration"))


@query
def last_ema_points(spark, d):
    return _plain(indicators.last_points(indicators.ema(views.chain_bars(spark, d), (5,)), 3).select("symbol", "expiry", "ts", half_up(F.col("ema5"), 4).alias("ema5")))


# Work lists, upserts and streams


@query
def work_list(spark, d):
    bars, _, settle = _base(spark, d)
    pairs = settlement.with_tte(settle, _now())
    stored = bars.where("symbol like 'C-%'").select("spot", "expiry").where(F.dayofmonth("expiry") % 2 == 0)
    todo, _ = work.work_list(pairs, stored, stored.where(F.dayofmonth("expiry") > 10), "signals")
    return _plain(todo)


@query
def active_durations(spark, d):
    bars, _, settle = _base(spark, d)
    return _plain(settlement.active_durations(settlement.with_tte(settle, _now()).where("live"), _now()).select("expiry", "duration"))


@query
def spot_upsert(spark, d):
    old = views.spot_bars(spark, d)
    new = old.where(F.unix_seconds("ts") % 14_400 == 0).withColumn("close", F.col("close") + 1)
    return _plain(newest_bars(new, old).select("ts", "close"))


@query
def stream_candles(spark, d):
    """The 60-minute candles that a stream over the events emits as final."""
    from wickwork.streaming.candles import stream_candles as candles

    source = f"{d}/events.parquet"
    schema = spark.read.parquet(source).schema
    # A stream reads folders of files; the events are one file or one folder.
    e = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(source if _is_folder(spark, source) else f"{d}/event[s].parquet")
    stream = e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("qty"), F.col("event_id").alias("seq"))
    out = fresh(spark, "stream")
    run = candles(stream, 60, ["symbol"]).writeStream.format("parquet").option("checkpointLocation", f"{out}/log").option("path", f"{out}/rows").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return _plain(spark.read.parquet(f"{out}/rows").drop("duration"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


@query
def squeeze_hit_rates(spark: SparkSession, d: str) -> DataFrame:
    """Red squeezes over the hourly candles of each event type, and how many were activated."""
    t = views.ticks(spark, d)
    bars = ticks_to_candles(t, 60, ["symbol"]).withColumns({"spot": F.lit("EVT"), "expiry": F.lit("2030-01-01").cast("date")})
    found = annotate_outcomes(detect.detect_red_squeeze(with_peak_after(bars), min_value=0.0))
    shaped = found.select("symbol", "state", F.col("ratio").alias("max_ratio"), F.lit(0.0).alias("univ_ratio"))
    return report.quality(shaped, ["symbol"], "fired", THRESHOLDS)


# Several durations at once


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bars and spot bars of 120 and 240 minutes."""
    bars = cut(views.chain_bars(spark, d).unionByName(views.chain_bars(spark, d, 240)), "chain")
    return bars, views.spot_bars(spark, d).unionByName(views.spot_bars(spark, d, 240)), views.expiries(bars)


@query
def outcomes_multi(spark, d):
    bars, spot, settle = _two(spark, d)
    found = run_signals(bars, spot, settle, min_values=FLOORS, durations=[120, 240])
    return _plain(found.select("signal", "duration", "symbol", "expiry", "entry_ts", "spot_price", "distance_pct", "ratio", "state", "univ_ratio", "univ_symbol"))


@query
def spot_by_duration(spark, d):
    bars, spot, _ = _two(spark, d)
    return _plain(with_spot(bars.select("spot", "symbol", "expiry", "duration", "ts"), spot).drop("spot"))


def _events_two(spark: SparkSession, d: str) -> DataFrame:
    bars, spot, settle = _two(spark, d)
    return run_events(bars, spot, settle, min_values=FLOORS, durations=[120, 240])


@query
def merge_events_multi(spark, d):
    return _plain(_events_two(spark, d).drop("spot", "settle_ts"))


@query
def hit_tree_multi(spark, d):
    return _plain(report.hit_tree(_events_two(spark, d), THRESHOLDS))


@query
def expiry_grid_multi(spark, d):
    return _plain(report.expiry_duration_grid(_events_two(spark, d), 2, [120, 240], sort="hits"))


@query
def panels_multi(spark, d):
    return _plain(report.expiry_panels(_events_two(spark, d)))


# Round trips: what is written to a table or a file is what is read


def _table(spark: SparkSession, name: str) -> str:
    return fresh(spark, name) + "/t"


@query
def candle_pages(spark, d):
    """Bars as pages with prices as text, each page twice, read again."""
    bars, at = views.chain_bars(spark, d), _table(spark, "pages")
    text = lambda c: F.col(c).cast("string").alias(c)
    one = F.struct(F.unix_seconds("ts").alias("time"), *[text(c) for c in candle_tables.VALUES])
    # A page is one series.
    pages = bars.groupBy(F.concat_ws("@", "symbol", "expiry").alias("symbol")).agg(F.collect_list(one).alias("result")).withColumn("resolution", F.lit("2h"))
    pages.unionByName(pages).write.json(at)
    return _plain(candle_tables.read_candle_pages(spark, at))


@query
def compact_candles(spark, d):
    """Bars as compact arrays, one file a series, read again."""
    bars, at = views.chain_bars(spark, d), _table(spark, "compact")
    row = F.concat_ws(",", F.unix_seconds("ts").cast("string"), *[F.col(c).cast("string") for c in candle_tables.VALUES])
    # A file is one series.
    files = bars.groupBy(*SERIES).agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("["), row, F.lit("]")))), ","), F.lit("]")).alias("value"))
    names = files.select(F.concat_ws("/", "spot", "expiry", "duration", "symbol").alias("folder"), "value")
    names.repartition("folder").write.partitionBy("folder").text(at)
    path = F.regexp_extract(F.url_decode(F.url_decode(F.col("_metadata.file_path"))), r"folder=(.*)/[^/]*$", 1)
    back = spark.read.text(at, wholetext=True, recursiveFileLookup=True).select(F.concat(path, F.lit(".json")).alias("p"), "value")
    return _plain(candle_tables.compact_rows(back))


@query
def candle_table(spark, d):
    """Bars written, some of their partitions written again, nothing written for nothing; the candles of one expiry."""
    bars, at = cut(views.chain_bars(spark, d), "chain"), _table(spark, "candles")
    candle_tables.write_candles(bars, at)
    candle_tables.write_candles(bars.where(F.dayofmonth("expiry") <= 7).withColumn("volume", F.col("volume") + 1), at)
    candle_tables.write_candles(bars.limit(0), at)
    return _plain(candle_tables.read_candles(spark, at).where("expiry <= '2024-01-16'").select("symbol", "expiry", "ts", "close", "volume"))


@query
def spot_table(spark, d):
    """Spot bars, an overlap stored again with other closes, and a range of days read."""
    bars, at = cut(views.spot_bars(spark, d), "spot"), _table(spark, "spot")
    candle_tables.upsert_spot(bars, at)
    candle_tables.upsert_spot(bars.where(F.unix_seconds("ts") % 14_400 == 0).withColumn("close", F.col("close") + 1), at)
    return _plain(candle_tables.read_spot(spark, at, "EVT", 120, "2024-01-05", "2024-01-20").select("ts", "close"))


def _product_id() -> Column:
    """The user of a chain's symbol and the day of its expiry as a number."""
    return F.get(F.split("symbol", "-"), F.lit(3)).cast("bigint") + 100 * F.dayofmonth("expiry")


@query
def instrument_list(spark, d):
    """Products of the chain as JSON, those without an underlying or a settlement left out, over older instruments."""
    bars, at = views.chain_bars(spark, d), _table(spark, "products")
    chain = bars.select("symbol", "expiry").distinct().withColumn("id", _product_id())
    settle = F.concat(F.col("expiry").cast("string"), F.when(F.col("id") % 2 == 0, "T08:00:00Z").otherwise("T12:00:00Z"))
    named = F.struct(F.when(F.col("id") % 7 != 0, "EVT").alias("symbol"))
    chain.select("symbol", "id", F.when(F.col("id") % 5 != 0, settle).alias("settlement_time"), named.alias("underlying_asset")).write.json(at)
    old = chain.where("id % 3 = 0").select(F.lit("EVT").alias("spot"), "expiry", "symbol", F.lit(-1).cast("bigint").alias("product_id"))
    return _plain(listed.build_instruments(listed.read_products(spark, at), old).drop("spot"))


@query
def settlements_learned(spark, d):
    """Settlement times that products teach, and those of every expiry with the defaults behind them."""
    bars = cut(views.chain_bars(spark, d), "chain")
    chain = bars.select("symbol", "expiry").distinct().withColumn("id", _product_id())
    settle = F.concat(F.col("expiry").cast("string"), F.when(F.col("id") % 2 == 0, "T08:00:00Z").otherwise("T09:30:00Z"))
    products = chain.where(F.dayofmonth("expiry") % 2 == 0).select("symbol", "id", settle.alias("settlement_time"), F.struct(F.lit("EVT").alias("symbol")).alias("underlying_asset"))
    exact, spots = listed.learn_settlements(products)
    pairs = bars.select("spot", "expiry").distinct()
    pairs = pairs.unionByName(pairs.withColumn("spot", F.lit("OWN"))).unionByName(pairs.withColumn("spot", F.lit("NEW")))
    return _plain(settlement.with_settlement(pairs, exact, spots, spark.createDataFrame([("OWN", 36_000)], "spot string, settle_seconds int")))


@query
def event_table(spark, d):
    """All events, every scope in one write; the first wall's scope is then stored again without rows."""
    events, at = cut(_events(spark, d).drop("settle_ts"), "events"), _table(spark, "events")
    result_tables.write_all_events(events, at)
    (first,) = events.where("signal = 'otm_wall'").agg(F.min("expiry")).first()
    if first is not None:
        result_tables.write_events(events.limit(0), at, "otm_wall", "EVT", str(first))
    return _plain(result_tables.read_events(spark, at).select("signal", "expiry", "duration", "type", "start_ts", "n", "univ_ratio", "instruments"))


@query
def pattern_table(spark, d):
    rows, at = to_pattern_rows(_signals(spark, d)).select("signal", "spot", "duration", "expiry", "symbol", "entry_ts", "signal_value"), _table(spark, "patterns")
    rows = cut(rows, "patterns")
    result_tables.write_patterns(rows, at)
    return _plain(result_tables.read_patterns(spark, at, rows.schema, "otm_wall", "EVT").select("symbol", "expiry", "entry_ts", "signal_value"))


@query
def trade_tables(spark, d):
    """Trade events and best trades written and read, as one list."""
    trade_at, best_at = _table(spark, "trades"), _table(spark, "best")
    result_tables.write_trades(_trade_events(spark, d), trade_at)
    best = cut(_best(spark, d), "best")
    result_tables.write_best_trades(best, best_at)
    made = result_tables.read_trades(spark, trade_at).select(F.lit("event").alias("kind"), "expiry", F.col("max_symbol").alias("symbol"), F.col("max_ratio").alias("ratio"))
    return _plain(made.unionByName(result_tables.read_best_trades(spark, best_at, best.schema).select(F.lit("best").alias("kind"), "expiry", "symbol", "ratio")))


@query
def snapshot_table(spark, d):
    """Two passes of a snapshot, the second over some chains only, without what has settled."""
    bars, at = cut(views.chain_bars(spark, d), "chain"), _table(spark, "snapshot")
    last = cut(indicators.last_points(bars, 2), "last")
    sink = result_tables.write_snapshot(at)
    sink(last, 0)
    sink(last.where(F.dayofmonth("expiry") % 2 == 0).withColumn("close", F.col("close") + 1), 1)
    stored = tables.read_table(spark, at, last.schema)
    return _plain(result_tables.prune_settled(stored, views.expiries(bars), _now()).select("symbol", "expiry", "ts", "close"))


@query
def inventory(spark, d):
    at = _table(spark, "inventory")
    candle_tables.write_candles(views.chain_bars(spark, d), at)
    return _plain(tables.list_inventory(candle_tables.read_candles(spark, at), ["spot", "expiry", "duration"]))


# Filters, resumption and functions


@query
def ratio_filters(spark, d):
    rows = cut(_trades(spark, d).select("symbol", "expiry", "low_ts", "ratio"), "trades")
    asked = [(">", 3.0, None), (">=", 4.0, None), ("<", 2.5, None), ("<=", 2.2, None), ("between", 3.0, 5.0)]
    parts = [filters.ratio_filter(rows, "ratio", op, lo, hi).withColumn("op", F.lit(op)) for op, lo, hi in asked]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _plain(out.groupBy("op", "expiry").agg(F.count("*").alias("n"), F.max("ratio").alias("top")))


@query
def settled_range(spark, d):
    return _plain(filters.settled_between(_best(spark, d), "2024-01-07", "2024-01-16", "EVT").select("symbol", "expiry", "ratio"))


@query
def recent_firings(spark, d):
    return _plain(filters.recent(_signals(spark, d), _now()).select("signal", "symbol", "expiry", "entry_ts"))


@query
def live_signals(spark, d):
    from wickwork.streaming.signals import live_signals as newest

    return _plain(newest(_signals(spark, d), _now(), 25).select("signal", "symbol", "expiry", "entry_ts"))


@query
def symbols_pending(spark, d):
    bars = cut(views.chain_bars(spark, d), "chain")
    chain = bars.select("spot", "expiry", "symbol").distinct()
    return _plain(work.pending_symbols(chain, bars.where("close > 1 and ts < '2024-01-12'")))


@query
def expiry_completeness(spark, d):
    bars = views.chain_bars(spark, d)
    ok = bars.groupBy("spot", "expiry", "symbol").agg((F.min("low") > 0.1).alias("ok"))
    return _plain(work.completeness(ok))


@query
def spot_required(spark, d):
    """Chains whose spot has any bar; half of them are given another spot."""
    bars = views.chain_bars(spark, d).withColumn("spot", F.when(F.dayofmonth("expiry") % 2 == 0, "EVT").otherwise("NONE"))
    return _plain(require_spot(bars, views.spot_bars(spark, d)).groupBy("expiry").agg(F.count("*").alias("n")))


@query
def scalar_functions(spark, d):
    """Every function of conditions over values below, at and above zero, and equality across types."""
    x = F.col("close") - F.col("open")
    f = FUNCTIONS
    rows = views.chain_bars(spark, d).select(
        "symbol", "expiry", "ts",
        f["log10"](x).alias("log10"), f["log"](x).alias("log"), f["exp"](x / 100).alias("exp"), f["sqrt"](x).alias("sqrt"), f["abs"](x).alias("abs"),
        f["floor"](x).alias("floor"), f["ceil"](x).alias("ceil"), f["sign"](x).alias("sign"), f["round"](x).alias("round"), f["pow"](x, F.lit(2)).alias("pow"),
        f["min"](x, F.lit(1.0)).alias("min"), f["max"](x).alias("max"), f["divide"](F.col("open"), f["floor"](x)).alias("divide"),
    )
    return _plain(rows.select("symbol", "expiry", "ts", *[half_up(F.col(c), 6).alias(c) for c in rows.columns[3:]]))


@query
def sql_functions(spark, d):
    """The same in SQL, with a function of the user's own; equality and lists compare numbers where either side is one."""
    from wickwork.functions.scalars import register_sql

    register_sql(spark, {"half_of": ("x double", "double", "x / 2")})
    bars = views.chain_bars(spark, d).selectExpr("symbol", "expiry", "ts", "close - open AS x", "cast(floor(close) % 4 AS string) AS digit")
    made = bars.selectExpr("symbol", "expiry", "ts", "round_up(log10_0(x) * 1000) AS a", "round_up(sqrt_0(x) * 1000) AS b", "round_up(div_0(1, floor(x)) * 1000) AS c", "half_of(round_up(x)) AS h", "digit = 1.0 AS one", "digit IN (2, 3) AS listed")
    return _plain(made)


@query
def default_filters(spark, d):
    """The usual condition of two signals; a floor below that of the run is refused."""
    rows = cut(to_pattern_rows(_signals(spark, d)), "patterns")
    guarded.check_floor("otm_wall", 0.5, FLOORS)
    wall = rows.where(guarded.default_filter("otm_wall", 0.5, max_tte=48))
    stairs = rows.where(guarded.default_filter("green_stairs", 1.0, min_len=3, max_equal=0))
    return _plain(wall.unionByName(stairs).select("signal", "symbol", "expiry", "entry_ts"))


# Streams over written slices


def _sliced(spark: SparkSession, bars: DataFrame, seconds: list[int]) -> DataFrame:
    """A stream that takes `bars` one slice of time at a time."""
    at = fresh(spark, "slices") + "/t"
    edges = [-(1 << 40), *seconds, 1 << 40]
    for lo, hi in zip(edges, edges[1:], strict=False):
        # One file a slice; a stream takes files in the order in which they were written.
        bars.where((F.unix_seconds("ts") >= lo) & (F.unix_seconds("ts") < hi)).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(at)


def _run_stream(stream: DataFrame, sink: Callable, log: str) -> None:
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()


#: 2024-01-09 and 2024-01-17, 12:00 UTC.
SLICES = [1_704_801_600, 1_705_492_800]


@query
def stream_signals(spark, d):
    """Firings of all detectors over the chain in three slices of time."""
    from wickwork.streaming.signals import detector_sink

    bars, spot, _ = _base(spark, d)
    out = fresh(spark, "fired")
    names = [*SERIES, "ts", *candle_tables.VALUES]
    _run_stream(_sliced(spark, bars.select(*names), SLICES), detector_sink(f"{out}/fired", f"{out}/open", cut(spot, "spot"), min_values=FLOORS), f"{out}/log")
    return _plain(spark.read.parquet(f"{out}/fired").select("signal", "symbol", "expiry", "entry_ts", "pattern_start", "signal_value"))


@query
def stream_outcomes(spark, d):
    """Signals of the time before the first slice's end, brought up to date by the bars that follow."""
    from wickwork.streaming.signals import outcome_sink

    bars, _, _ = _base(spark, d)
    first = bars.where(F.unix_seconds("ts") < SLICES[0])
    found = cut(annotate_outcomes(detect.detect_red_squeeze(with_peak_after(first), min_value=0.0)).select(*SERIES, "signal", "entry_ts", "trigger_high", "state", "ratio", "peak_after"), "signals")
    out = fresh(spark, "outcomes")
    tables.write_partitioned(found, f"{out}/t", ["spot", "expiry"])
    later = bars.where(F.unix_seconds("ts") >= SLICES[0]).select(*SERIES, "ts", "high")
    _run_stream(_sliced(spark, later, SLICES[1:]), outcome_sink(f"{out}/t", found.schema), f"{out}/log")
    return _plain(tables.read_table(spark, f"{out}/t", found.schema).select("symbol", "expiry", "entry_ts", "state", "ratio", "peak_after"))


@query
def stream_indicators(spark, d):
    """Averages and volatilities of the chain from a stream, and the newest points of each series as its snapshot."""
    from wickwork.streaming.signals import snapshot_sink
    from wickwork.streaming.signals import stream_indicators as indicated

    bars = cut(views.chain_bars(spark, d).select(*SERIES, "ts", *candle_tables.VALUES), "chain")
    out = fresh(spark, "indicators")
    points = indicated(_sliced(spark, bars, []), (5,), (5,))
    _run_stream(points, snapshot_sink(f"{out}/t", 3), f"{out}/log")
    rows = spark.read.parquet(f"{out}/t")
    return _plain(rows.select("symbol", "expiry", "ts", half_up(F.col("ema5"), 4).alias("ema5"), half_up(F.col("vol5"), 4).alias("vol5")))


@query
def stream_spot(spark, d):
    """Spot bars and then some of them again with other closes, merged by a stream."""
    from wickwork.streaming.candles import spot_upsert_sink

    bars = cut(views.spot_bars(spark, d), "spot")
    again = bars.where(F.unix_seconds("ts") % 14_400 == 0).withColumns({"close": F.col("close") + 1, "volume": F.col("volume") + 1})
    out = fresh(spark, "spot-stream")
    _run_stream(_sliced(spark, bars.unionByName(again), []), spot_upsert_sink(f"{out}/t"), f"{out}/log")
    return _plain(candle_tables.read_spot(spark, f"{out}/t", "EVT", 120, "2024-01-01", "2030-01-01").select("ts", "close"))


@query
def stream_enriched(spark, d):
    """Bars of a stream with settlement and product, those of settled expiries left out."""
    from wickwork.streaming.candles import enrich, live_only

    bars, _, settle = _base(spark, d)
    settle = cut(settle.withColumn("settle_ts", F.timestamp_seconds(F.unix_seconds("settle_ts") - 86_400)), "settle")
    listed_ids = cut(bars.select("spot", "expiry", "symbol").distinct().withColumn("product_id", _product_id()), "listed")
    out = fresh(spark, "enriched")
    live = live_only(enrich(_sliced(spark, bars, []), settle, listed_ids))
    live.writeStream.format("parquet").option("checkpointLocation", f"{out}/log").option("path", f"{out}/rows").trigger(availableNow=True).start().awaitTermination()
    return _plain(spark.read.parquet(f"{out}/rows").select("symbol", "expiry", "ts", "product_id", "settle_ts"))


@query
def live_snapshot(spark, d):
    from wickwork.streaming.signals import live_snapshot as snapshot

    bars, spot, settle = _base(spark, d)
    found = run_signals(bars, spot, settle, min_values=FLOORS, durations=[120])
    rows = snapshot(bars, found, spot.withColumn("duration", F.lit(60)), settle, _now(), 10)
    names = F.transform("signals", lambda x: F.concat_ws("/", x["signal"], x["symbol"], F.unix_seconds(x["entry_ts"]).cast("string")))
    return _plain(rows.select("expiry", "instruments", "durations", "n_signals", "hours_to_expiry", "spot_price", F.coalesce(names, F.array().cast("array<string>")).alias("signals")))
