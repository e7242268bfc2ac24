"""Operators on what grows: many moments, long series and chains, and the plans that they have."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import at, bars
from wickwork.functions.candles import SERIES
from wickwork.functions.scalars import FUNCTIONS, loose_equal, loose_in, register_function
from wickwork.operators import counters, indicators, merge, report, settlement, trades
from wickwork.operators.asof import spot_for_duration
from wickwork.operators.outcomes import with_peak_after
from wickwork.operators.stab import stab_join
from wickwork.sources.candles import write_clustered


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hours", [1, 24, 1000])
def test_stabbing_equals_all_pairs(spark, hours):
    rng = random.Random(1)
    spans = [(i, at(a), at(a + rng.choice((0, 1, 60, 3000, 100_000)))) for i, a in enumerate(rng.randrange(-50_000, 50_000) for _ in range(60))] + [(99, at(0), None), (98, None, at(0))]
    moments = [(at(rng.randrange(-60_000, 160_000)),) for _ in range(80)] + [(None,), (spans[3][1],), (spans[3][2],)]
    got = stab_join(spark.createDataFrame(spans, "id int, a timestamp, b timestamp"), spark.createDataFrame(moments, "at timestamp"), "a", "b", bucket_hours=hours)
    want = sorted((i, t) for i, a, b in spans if a and b for (t,) in moments if t and a <= t < b)
    assert sorted((r["id"], r["at"].astimezone(want[0][1].tzinfo)) for r in got.select("id", "at").collect()) == want
    plan = plan_of(got)
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_heatmap_at_one_moment_is_the_heatmap(spark):
    b = bars(spark, [(5, 6)] * 48)
    settle = b.select("spot", "expiry").distinct().withColumn("settle_ts", F.lit(at(5000)).cast("timestamp"))
    events = spark.createDataFrame([("EVT", at(0).date(), 60, "C", 3.0, at(60 * k + 7 * k), [f"C-{k % 5}", f"C-{k % 3}"]) for k in range(30)], "spot string, expiry date, duration int, type string, max_value double, end_ts timestamp, instruments array<string>")
    events = events.withColumn("expiry", F.lit(b.first()["expiry"]))
    moments = [at(60 * k + 13) for k in (0, 5, 11, 20, 40)]
    alive = settlement.alive_at(settle, b, spark.createDataFrame([(m,) for m in moments], "at timestamp"))
    got = report.heatmap_at(events, alive, 60, "C", 6)
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    rows = got.collect()
    for m in moments:
        when = F.lit(m).cast("timestamp")
        want = report.heatmap(events, settlement.alive_expiries(settle, b, when), when, 60, "C", 6).select("slot", "fired", "names").collect()
        mine = [r for r in rows if r["at"].timestamp() == m.timestamp()]
        assert sorted((r["slot"], r["fired"], r["names"]) for r in mine) == sorted(map(tuple, want))
    assert settlement.alive_at(settle, b, spark.createDataFrame([(at(6000),), (at(-1),)], "at timestamp")).count() == 0


def test_capped_merge_by_islands_equals_one_sweep(spark):
    rng, rows, start = random.Random(2), [], 0
    for k in range(400):
        start += rng.choice((0, 30, 60, 60, 900, 20_000)) if k % 40 else 50_000
        rows.append(("EVT", at(0).date(), 60, f"C-{k % 7}", "C", at(start), at(start + rng.choice((0, 60, 600, 4000))), 1.0, 2.0, 3, 2.0 + k % 5))
    frame = spark.createDataFrame(rows, "spot string, expiry date, duration int, symbol string, type string, low_ts timestamp, high_ts timestamp, low_price double, high_price double, hold_candles int, ratio double")
    got = merge.merge_trades(frame, 5).select("start_ts", "end_ts", "n").collect()
    whole = merge._sweep(5)(frame.toPandas())
    want = whole.groupby("event").agg(start=("low_ts", "min"), end=("high_ts", "max"), n=("event", "size"))
    assert sorted((r["start_ts"], r["end_ts"], r["n"]) for r in got) == sorted((s.to_pydatetime(), e.to_pydatetime(), n) for s, e, n in want.itertuples(index=False))
    sizes = merge.islands(frame, ["spot", "expiry", "duration", "type"], "low_ts", "high_ts").groupBy("island").count().agg(F.max("count")).first()[0]
    assert 1 < sizes < 80 and len(got) > 20


def plain_ema(close, p):
    out = [None] * len(close)
    for i in range(p - 1, len(close)):
        out[i] = sum(close[:p]) / p if i == p - 1 else close[i] * 2 / (p + 1) + out[i - 1] * (1 - 2 / (p + 1))
    return out


@pytest.mark.parametrize("block", [1, 3, 7, 4096])
def test_averages_by_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(indicators, "BLOCK", block)
    rng = random.Random(3)
    many = [bars(spark, [(5, rng.uniform(1, 9)) for _ in range(n)], symbol=f"C-{n}") for n in (1, 4, 5, 6, 23, 60)]
    rows = many[0]
    for m in many[1:]:
        rows = rows.unionByName(m)
    # A series with gaps in time.
    rows = rows.where("symbol <> 'C-60' or hour(ts) % 5 <> 2").withColumn("more", F.lit("x"))
    got = {}
    for r in indicators.ema(rows, (1, 5, 9)).orderBy("symbol", "ts").collect():
        got.setdefault(r["symbol"], []).append(r)
    for series in got.values():
        close = [r["close"] for r in series]
        for p in (1, 5, 9):
            assert [r[f"ema{p}"] for r in series] == pytest.approx(plain_ema(close, p), abs=1e-9) if len(close) >= p else all(r[f"ema{p}"] is None for r in series)
    assert len(got) == 6 and indicators.ema(rows.limit(0), (5,)).count() == 0


def test_a_long_series_is_spread(spark):
    """One series of 200,000 bars: no block holds more than BLOCK bars."""
    n = 200_000
    rows = spark.range(n).select(F.lit("EVT").alias("spot"), F.lit("2030-01-01").cast("date").alias("expiry"), F.lit(60).alias("duration"), F.lit("C-1").alias("symbol"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), (F.col("id") % 97 + 1).cast("double").alias("close"))
    size = rows.groupBy(F.floor(F.unix_seconds("ts") / (60 * 60 * indicators.BLOCK))).count().agg(F.max("count"), F.count("*")).first()
    assert size[0] == indicators.BLOCK and size[1] > 40
    last = indicators.ema(rows, (20,)).orderBy(F.desc("ts")).first()
    close = pd.Series([i % 97 + 1.0 for i in range(n)])
    seeded = pd.concat([pd.Series([close[:20].mean()]), close[20:]])
    assert last["ema20"] == pytest.approx(seeded.ewm(alpha=2 / 21, adjust=False).mean().iloc[-1])


def plain_partition(high, low, cap):
    todo, found = [(0, len(high))], []
    while todo and len(found) < cap:
        a, b = todo.pop()
        if b - a < 2:
            continue
        top = a + int(np.argmax(high[a:b]))
        if top == a:
            todo.append((a + 1, b))
            continue
        bottom = a + int(np.argmin(low[a:top]))
        if low[bottom] > 0 and high[top] > 0:
            found.append((bottom, top))
        todo += [(a, bottom), (top + 1, b)]
    return found


def frame(high, low):
    n = len(high)
    return pd.DataFrame({"spot": "EVT", "expiry": at(0).date(), "duration": 60, "symbol": "C-1", "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "high": high, "low": low})


def test_trades_by_extremes_equal_scanned_ones():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 5, 60, 300):
        high = rng.integers(1, 20, n).astype(float)
        low = high - rng.integers(0, 3, n)
        for cap in (3, 200):
            got = trades._partition(cap)(frame(high, low)) if n else None
            want = plain_partition(high, low, cap)
            assert n == 0 or got["hold_candles"].tolist() == [b - a for a, b in want]


def test_a_long_decline_takes_no_time():
    n = 100_000
    high = np.arange(2 * n, n, -1.0)
    began = time.time()
    assert trades._partition(200)(frame(high, high - 0.5)).empty and time.time() - began < 20


def test_all_durations_come_from_one_shuffle_of_spot(spark):
    spot = bars(spark, [(5, 6)] * 48, "x", 30).drop("expiry", "symbol")
    many = spot_for_duration(spot, [60, 90, 120, 180, 240, 360, 480, 720])
    few = spot_for_duration(spot, [60])
    assert plan_of(many).count("Exchange") == plan_of(few).count("Exchange") and many.select("duration").distinct().count() == 8


def test_windows_over_clustered_candles_need_no_exchange(spark, tmp_path):
    b = bars(spark, [(5, 6), (6, 5), (5, 7)]).unionByName(bars(spark, [(5, 4)] * 3, "P-EVT-100-2"))
    stored = write_clustered(b, "clustered_test", str(tmp_path / "t"), 4)
    again = with_peak_after(stored)
    assert "Exchange" not in plan_of(again) and "Exchange" in plan_of(with_peak_after(b))
    cols = ["symbol", "ts", "peak_after", "peak_bars"]
    assert sorted(map(str, again.select(*cols).collect())) == sorted(map(str, with_peak_after(b).select(*cols).collect()))
    assert "Exchange" not in plan_of(stored.groupBy(*SERIES).count())


def test_counts_come_with_the_rows(spark):
    tagged = spark.createDataFrame([(1,), (None,), (3,), (None,)], "moneyness_bucket int")
    rows, seen = counters.observe_excluded(tagged)
    assert rows.count() == 2 and seen.get == {"excluded": 2}
    made, scan = counters.observe_scan(spark.createDataFrame([(1.0,), (5.0,), (9.0,)], "ratio double"), 5.0)
    assert made.count() == 2 and scan.get == {"raw_trades": 3, "qualifying": 2}
    rows, fields = counters.observe_fields(spark.createDataFrame([(1, None, 2)], "a int, `b.c` int, d int"), ["a", "b.c"])
    rows.collect()
    assert counters.unpopulated(fields) == ["b.c"]


def test_equality_never_fails(spark):
    rows = spark.createDataFrame([("abc", 0.0, True, 1), ("1", 1.0, False, None), (None, None, None, 0), ("true", 2.0, True, 2)], "t string, x double, f boolean, i int")
    c = F.col
    got = rows.select(
        loose_equal(c("t"), c("x")).alias("a"), loose_equal(c("t"), F.lit("1")).alias("b"), loose_equal(c("x"), c("f")).alias("c"), loose_equal(c("t"), c("f")).alias("d"),
        loose_equal(c("x"), c("i")).alias("e"), loose_in(c("t"), F.lit("abc"), F.lit("1")).alias("g"), loose_in(c("i"), F.lit(2), F.lit("x")).alias("h"), FUNCTIONS["ne"](c("t"), F.lit(7)).alias("k"),
    )
    assert [tuple(r) for r in got.collect()] == [
        (True, False, False, False, False, True, False, True), (False, True, False, False, False, True, True, True),
        (True, False, True, True, True, False, True, True), (False, False, False, True, True, False, True, True),
    ]


def test_functions_of_ones_own(spark):
    register_function("double_of", lambda c: c * 2)
    try:
        assert spark.range(3).select(FUNCTIONS["double_of"](F.col("id")).alias("x")).collect()[2]["x"] == 4
        with pytest.raises(ValueError, match="double_of is taken"):
            register_function("double_of", lambda c: c)
    finally:
        del FUNCTIONS["double_of"]
