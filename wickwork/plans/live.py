"""Registered queries over many moments, over streams with keyed state, and over counts that come with the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickwork.functions.candles import SERIES
from wickwork.functions.scalars import FUNCTIONS, register_sql
from wickwork.operators import counters, detect, report, settlement, trades
from wickwork.operators.outcomes import annotate_outcomes, with_peak_after
from wickwork.plans import views
from wickwork.plans.queries import FLOORS, SLICES, _base, _events, _plain, _run_stream, _sliced, _tagged, query
from wickwork.plans.run import extract_patterns
from wickwork.sources import candles as candle_tables
from wickwork.sources.scratch import cut, fresh
from wickwork.streaming import outcomes, signals
from wickwork.streaming.state import final_bars, rocksdb, with_open_bars

#: Seconds between the moments that are asked for.
EVERY = 43_200


def _moments(bars):
    """Every half day on which the chain has a bar."""
    return bars.select(F.timestamp_seconds(F.floor(F.unix_seconds("ts") / EVERY) * EVERY).alias("at")).distinct()


@query
def alive_expiries_at(spark, d):
    """Expiries alive at each half day, in one join."""
    bars, _, settle = _base(spark, d)
    return _plain(settlement.alive_at(settle, bars, _moments(bars)).select(F.col("at").alias("moment"), "expiry", "listed_ts"))


@query
def heatmap_at(spark, d):
    """The heatmap of walls at each half day."""
    bars, _, settle = _base(spark, d)
    events = cut(_events(spark, d).where("signal = 'otm_wall'").drop("settle_ts"), "walls")
    alive = cut(settlement.alive_at(settle, bars, _moments(bars)), "alive")
    return _plain(report.heatmap_at(events, alive, 120, "C", 12).drop("spot").withColumnRenamed("at", "moment"))


@query
def clustered_candles(spark, d):
    """Peaks over candles stored by series, which are windowed without an exchange."""
    at = fresh(spark, "clustered")
    bars = candle_tables.write_clustered(views.chain_bars(spark, d), "clustered_" + at.rsplit("-", 1)[1], at + "/t", 8)
    return _plain(with_peak_after(bars).select("symbol", "expiry", "ts", "peak_after", "peak_bars"))


@query
def loose_equality(spark, d):
    """Equality and lists over texts that are no numbers, numbers and missing values; nothing raises."""
    eq, ne, among = FUNCTIONS["eq"], FUNCTIONS["ne"], FUNCTIONS["in"]
    register_sql(spark)
    digit = F.floor(F.col("close")) % 4
    text = F.when(digit == 0, "abc").when(digit == 1, "1").when(digit == 2, "").otherwise(F.lit(None).cast("string"))
    rows = views.chain_bars(spark, d).select("symbol", "expiry", "ts", text.alias("t"), digit.cast("double").alias("x"), (F.col("close") > F.col("open")).alias("up"))
    return _plain(rows.select(
        "symbol", "expiry", "ts", eq(F.col("t"), F.lit(1.0)).alias("text_one"), eq(F.col("t"), F.lit(0)).alias("text_zero"), ne(F.col("t"), F.lit("abc")).alias("not_abc"),
        eq(F.col("x"), F.col("up")).alias("number_flag"), among(F.col("t"), F.lit("1"), F.lit("abc")).alias("listed"), among(F.col("x"), F.lit("x"), F.lit(3)).alias("mixed"),
        F.expr("eq_text_0(t, x)").alias("sql_zero"), F.expr("eq_texts(t, '1')").alias("sql_text"),
    ))


@query
def counted_rows(spark, d):
    """Rows written and the counts that come out of the same jobs: events without moneyness, trades before and after the ratio, empty fields."""
    kept, excluded = counters.observe_excluded(_tagged(spark, d))
    kept = cut(kept, "tagged")
    made, scan = counters.observe_scan(trades.find_trades(views.chain_bars(spark, d), min_ratio=0.0), 5.0)
    made = cut(made, "trades")
    bars, spot, settle = _base(spark, d)
    rows, seen = counters.observe_fields(extract_patterns(bars, spot, settle, ["red_squeeze"]), ["distance_pct", "equal_steps", "signal_value", "tte_hours", "dist"])
    cut(rows, "fields")
    tables = kept.agg(F.count("*").alias("n")).select(F.lit("tagged").alias("of"), "n").unionByName(made.agg(F.count("*").alias("n")).select(F.lit("trades").alias("of"), "n"))
    counts = [("excluded", excluded.get["excluded"]), ("raw_trades", scan.get["raw_trades"]), ("qualifying", scan.get["qualifying"]), *[(f"empty {c}", 1) for c in counters.unpopulated(seen)]]
    return tables.unionByName(spark.createDataFrame(counts, "of string, n bigint"))


# Streams


def _live(spark, d, late="1 hour"):
    """(a stream of the chain in three slices of time, with settle_ts and a watermark; spot; settlements)."""
    bars, spot, settle = _base(spark, d)
    names = [*SERIES, "ts", *candle_tables.VALUES]
    known = bars.select(*names).join(settle, ["spot", "expiry"])
    return _sliced(spark, known, SLICES).withWatermark("ts", late), cut(spot, "spot"), cut(settle, "settle")


@query
def stream_expiring(spark, d):
    """Firings of all detectors over a stream whose state ends at settlement."""
    stream, spot, _ = _live(spark, d)
    out = fresh(spark, "expiring")
    with rocksdb(spark):
        _run_stream(with_open_bars(stream), signals.firing_sink(f"{out}/fired", spot, min_values=FLOORS), f"{out}/log")
    return _plain(spark.read.parquet(f"{out}/fired").select("signal", "symbol", "expiry", "entry_ts", "pattern_start", "signal_value"))


@query
def stream_pass(spark, d):
    """What a stream publishes pass by pass: all signals, the newest bars of live series, and a board of their chains."""
    stream, spot, settle = _live(spark, d)
    out = fresh(spark, "pass")
    with rocksdb(spark):
        _run_stream(with_open_bars(stream), outcomes.live_pass_sink(f"{out}/t", spot, settle, min_values=FLOORS, points=3), f"{out}/log")
    table = lambda name: outcomes.read_pass(spark, f"{out}/t", name, spark.read.parquet(f"{out}/t/{name}").drop("epoch").schema)
    shown = table("signals").select(F.col("signal").alias("kind"), "symbol", "expiry", F.col("entry_ts").alias("moment"), F.col("signal_value").alias("value"))
    points = table("points").select(F.lit("point").alias("kind"), "symbol", "expiry", F.col("ts").alias("moment"), F.col("close").alias("value"))
    board = table("board").select(F.lit("board").alias("kind"), F.col("instruments").cast("string").alias("symbol"), "expiry", F.col("last_bar").alias("moment"), F.col("n_signals").cast("double").alias("value"))
    return _plain(shown.unionByName(points).unionByName(board))


@query
def stream_followed(spark, d):
    """Signals of the time before the first slice's end, followed by a join of two streams."""
    bars, _, _ = _base(spark, d)
    first = bars.where(F.unix_seconds("ts") < SLICES[0])
    found = cut(annotate_outcomes(detect.detect_red_squeeze(with_peak_after(first), min_value=0.0)).select(*SERIES, "signal", "entry_ts", "trigger_high", "state", "ratio", "peak_after"), "signals")
    out = fresh(spark, "followed")
    found.write.parquet(f"{out}/opened")
    opened = spark.readStream.schema(found.schema).parquet(f"{out}/opened")
    later = _sliced(spark, bars.where(F.unix_seconds("ts") >= SLICES[0]).select(*SERIES, "ts", "high"), SLICES[1:])
    _run_stream(outcomes.later_bars(opened, later), outcomes.peak_sink(f"{out}/peaks"), f"{out}/log")
    return _plain(outcomes.followed_outcomes(found, f"{out}/peaks").select("symbol", "expiry", "entry_ts", "state", "ratio", "peak_after"))


@query
def stream_final(spark, d):
    """Bars of which some came wrong or twice: what a stream gives once no correction can still come."""
    bars, at = cut(views.chain_bars(spark, d).select(*SERIES, "ts", *candle_tables.VALUES), "chain"), F.unix_seconds("ts")
    wrong = bars.where(at % 14_400 == 0).withColumns({"close": F.col("close") + 1, "volume": F.col("volume") - 0.5})
    out = fresh(spark, "final")
    late = "12 hours"
    stream = final_bars(_sliced(spark, wrong.unionByName(bars).unionByName(bars.where(at % 28_800 == 0)), SLICES), late)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/log").option("path", f"{out}/rows").trigger(availableNow=True).start().awaitTermination()
    # The last hours are not final when the stream ends.
    newest = bars.agg(F.max("ts").alias("newest"))
    rows = spark.read.parquet(f"{out}/rows").join(F.broadcast(newest)).where(F.col("ts") < F.col("newest") - F.expr(f"interval {late}"))
    return _plain(rows.select("symbol", "expiry", "ts", "close", "volume"))

