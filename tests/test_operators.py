"""Golden cases of the other operators."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from helpers import at, bars, reds, spots
from wickwork.functions import bands, scalars, timegrid
from wickwork.functions.candles import with_instrument_cols
from wickwork.operators import asof, detect, filters, guarded, indicators, merge, report, rollup, settlement, trades, universe, walkforward
from wickwork.operators.outcomes import annotate_outcomes, with_peak_after
from wickwork.plans.run import run_events, to_pattern_rows
from wickwork.sources import results


def one(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


@pytest.mark.parametrize(("local", "minutes", "slot"), [("2024-01-02T18:10:00+0530", 60, "2024-01-02T17:30:00+0530"), ("2024-01-03T05:00:00+0530", 1440, "2024-01-02T17:30:00+0530")])
def test_slots(spark, local, minutes, slot):
    df = spark.createDataFrame([(local,)], "s string").withColumn("t", timegrid.ist_parse("s"))
    assert one(df.withColumn("u", timegrid.ist_string(timegrid.slot_start("t", minutes))), "u") == [(slot,)]


def test_slot_formula_equals_window(spark):
    t = spark.range(0, 3000).select(F.timestamp_seconds(F.col("id") * 420 + 1_700_000_000).alias("ts"))
    for d in (5, 45, 90, 720, 1440):
        w = F.window("ts", f"{d} minutes", startTime=f"{720 % d} minutes")["start"]
        assert t.where(w != timegrid.slot_start("ts", d)).count() == 0


@pytest.mark.parametrize(("duration", "skipped"), [(5, 20), (15, 7), (60, 2), (1440, 1)])
def test_warmup(spark, duration, skipped):
    rows = [(0.05, 0.06), *[(1.0, 2.0)] * 30]
    assert rollup.strip_warmup(bars(spark, rows, duration=duration)).count() == 30 - skipped


def test_rollup_ignores_zero_lows(spark):
    rows = [(5, 6, 0, 5), (5, 9, 3, 7), (7, 7, 0, 4), (4, 8, 2, 6)]
    got = rollup.rollup_many(bars(spark, rows, duration=30), [60], bases=(5, 30))
    assert sorted(one(got, "open", "high", "low", "close", "volume", "duration")) == [(5.0, 9.0, 3.0, 7.0, 2.0, 60), (7.0, 8.0, 2.0, 6.0, 2.0, 60)]
    again = rollup.rollup(bars(spark, rows, duration=30), 120)
    assert one(again, "low", "duration") == [(2.0, 120)]


def test_sources_for():
    assert rollup.sources_for([90, 360, 7]) == [(90, 30), (360, 360)]


def test_interval_merge(spark):
    rows = [("s", 1, 3, "A", "slHit"), ("s", 3, 5, "B", "pending"), ("s", 7, 9, "A", "slHit")]
    df = spark.createDataFrame(
        [(s, "EVT", date(2024, 2, 1), 60, f"C-EVT-1-{k}", at(a), at(b), 1.0, 2.0, st, 3.0 if k == "B" else 0.0, f"C-EVT-9-{k}") for s, a, b, k, st in rows],
        "signal string, spot string, expiry date, duration int, symbol string, pattern_start timestamp, entry_ts timestamp, signal_value double, ratio double, state string, univ_ratio double, univ_symbol string",
    )
    got = sorted(one(merge.merge_events(df), "n", "state", "univ_ratio", "univ_symbol"))
    assert got == [(1, "slHit", 0.0, None), (2, "pending", 3.0, "C-EVT-9-B")]


def test_trade_split(spark):
    rows = [(10, 10), (100, 100), (0.1, 0.1), (50, 50)]
    got = one(trades.find_trades(bars(spark, rows)), "ratio", "hold_candles")
    assert sorted(got) == [(10.0, 1), (500.0, 1)]


def test_trade_merge_cap(spark):
    rows = [("EVT", date(2024, 2, 1), 60, "C", f"s{i}", at(a * 60), at(b * 60), 1.0, 2.0, 5, r) for i, (a, b, r) in enumerate([(0, 90, 9.0), (5, 95, 7.0), (6, 200, 8.0)])]
    df = spark.createDataFrame(rows, "spot string, expiry date, duration int, type string, symbol string, low_ts timestamp, high_ts timestamp, low_price double, high_price double, hold_candles int, ratio double")
    got = sorted(one(merge.merge_trades(df), "n", "max_symbol"))
    assert got == [(1, "s2"), (2, "s0")]


def test_best_trade(spark):
    rows = [(4, 4, 4, 4), (2, 3, 2, 2), (5, 10, 5, 5)]
    assert one(trades.best_trade(bars(spark, rows)), "ratio", "entry_price", "peak_price", "hold_candles") == [(5.0, 2.0, 10.0, 1)]


def chain(spark):
    """A call fires at strike 950 paying 5x, while strike 900 pays 100x."""
    red, p = reds(16, 4, 1)
    fire = bars(spark, [(1000, 1001), *red, (p, p + 2), (p, 5 * (p + 2), p, p)], "C-EVT-950-1")
    cheap = bars(spark, [(1, 1)] * 5 + [(1, 100, 1, 1)], "C-EVT-900-1")
    return fire.unionByName(cheap)


@pytest.mark.parametrize(("mode", "ratio"), [("all_same_type", 100.0), ("further_otm", 5.0)])
def test_universe_modes(spark, mode, ratio):
    c = chain(spark)
    sig = detect.detect_red_squeeze(with_peak_after(c))
    assert one(universe.universe_max(sig, c, mode=mode), "univ_ratio") == [(ratio,)]


def test_cutoff_is_inclusive(spark):
    df = spark.createDataFrame([(at(0), at(90)), (at(6), at(90)), (at(0), None)], "entry_ts timestamp, settle_ts timestamp")
    assert filters.apply_firing_cutoff(df).count() == 2
    assert filters.apply_firing_cutoff(df, 0).count() == 3


@pytest.mark.parametrize(("close", "kept"), [(94.0, 0), (94.1, 1)])
def test_opposite_filter(spark, close, kept):
    spot = bars(spark, [(100.0, 100.0, 90.0, close)], "x").drop("expiry", "symbol")
    sig = spark.createDataFrame([("EVT", 60, "C-EVT-1-1", at(0))], "spot string, duration int, symbol string, entry_ts timestamp")
    assert filters.apply_opposite_filter(sig, spot).count() == kept
    assert filters.apply_opposite_filter(sig.withColumn("spot", F.lit("none")), spot).count() == 1


def test_asof(spark):
    spot = spots(spark, [1.0, 2.0], duration=60)
    left = spark.createDataFrame([("EVT", at(30)), ("EVT", at(60)), ("EVT", at(-1)), ("EVT", at(5000))], "spot string, ts timestamp").withColumn("duration", F.lit(60))
    want = [(-1, None), (30, 1.0), (60, 2.0), (5000, 2.0)]
    minutes = (F.unix_seconds("ts") - 1_704_067_200) / 60
    for got in (asof.with_spot(left, spot), asof.asof_join(left, spot.select("spot", "ts", F.col("close").alias("spot_close")), "ts", ["spot"], ["spot_close"], bucket_days=1)):
        assert sorted(one(got, minutes, "spot_close"), key=lambda x: x[0]) == want


def test_spot_is_that_of_the_duration(spark):
    spot = spots(spark, [7.0] * 60, 5).unionByName(spots(spark, [2.0, 3.0, 4.0, 5.0], 60)).unionByName(spots(spark, [100.0, 200.0], 240))
    left = spark.createDataFrame([("EVT", d, at(m)) for d in (60, 240) for m in (0, 130, 239, 241, 5000, -5)] + [("EVT", 15, at(10))], "spot string, duration int, ts timestamp")
    want = {(60, 0): 2.0, (60, 130): 4.0, (60, 239): 5.0, (60, 241): 5.0, (60, 5000): 5.0, (60, -5): None, (240, 0): 100.0, (240, 130): 100.0, (240, 239): 100.0, (240, 241): 200.0, (240, 5000): 200.0, (240, -5): None, (15, 10): None}
    minutes = ((F.unix_seconds("ts") - 1_704_067_200) / 60).cast("int")
    for got in (asof.with_spot(left, spot), asof.with_spot(left, spot, days=None), asof.with_spot(left, spot, days=3), asof.with_spot_bar(left, spot)):
        assert {(r[0], r[1]): r[2] for r in got.select("duration", minutes, "spot_close").collect()} == want


def test_days_of_a_series_are_apart(spark):
    """Bucketed and plain joins agree, and no window of the bucketed one holds a whole series."""
    import random

    rng = random.Random(1)
    spot = spark.createDataFrame([("EVT", 60, at(rng.randrange(60_000)), float(i)) for i in range(200)], "spot string, duration int, ts timestamp, close double")
    left = spark.createDataFrame([("EVT", 60, at(rng.randrange(-3000, 80_000)), i) for i in range(500)], "spot string, duration int, ts timestamp, i int")
    got = [sorted(map(str, asof.with_spot(left, spot, days=d).collect())) for d in (None, 1, 7)]
    assert got[0] == got[1] == got[2]
    plan = asof.with_spot(left, spot)._jdf.queryExecution().optimizedPlan().toString()
    assert all("__b" in line for line in plan.splitlines() if "Window" in line)


def test_bands(spark):
    df = spark.createDataFrame([(0.0, -1.5, 12.5)], "z double, a double, b double")
    got = df.select(bands.band_tightest(F.col("z"), bands.EMA_SPREAD_BANDS).alias("e"), bands.band_tightest(F.col("z"), bands.VOLATILITY_BANDS).alias("v"), bands.band_label(bands.bucket_first(F.col("a"), bands.MONEYNESS_BUCKETS), bands.MONEYNESS_BUCKETS).alias("l"), bands.band_label(bands.bucket_first(F.col("b"), bands.MONEYNESS_BUCKETS), bands.MONEYNESS_BUCKETS).alias("h"))
    assert tuple(got.first()) == (4, 0, "±1.5%", "12.5%+ OTM")


def test_ema(spark):
    got = indicators.ema(bars(spark, [(i, i) for i in range(1, 6)]), (3,)).orderBy("ts")
    assert [r["ema3"] for r in got.collect()] == [None, None, 2.0, 3.0, 4.0]


def test_scalars(spark):
    df = spark.createDataFrame([(-2.5, 0.0)], "x double, z double")
    got = df.select(scalars.FUNCTIONS["round"](F.col("x")), scalars.log10(F.col("z")), scalars.sqrt(F.col("x")), scalars.divide(F.lit(1), F.col("z")), scalars.FUNCTIONS["max"](F.col("x")))
    assert tuple(got.first()) == (-2, 0.0, 0.0, 0.0, -2.5)
    scalars.register_sql(spark, {"twice": ("x double", "double", "2 * x")})
    assert spark.sql("select div_0(1, 0), round_up(-2.5), twice(3)").first()[0] == 0
    with pytest.raises(ValueError):
        scalars.register_sql(spark, {"div_0": ("x double", "double", "x")})


@pytest.mark.parametrize(("n", "want"), [(10, [(5, 6), (6, 7), (7, 10)]), (5, [(3, 5)]), (0, [])])
def test_folds(spark, n, want):
    df = spark.createDataFrame([(date(2024, 1, i + 1),) for i in range(n)], "expiry date")
    got = walkforward.build_folds(df).orderBy("fold").collect()
    assert [(r["train_end"].day, r["test_end"].day) for r in got] == want


def test_fold_sides(spark):
    folds = spark.createDataFrame([(1, date(2024, 3, 10), date(2024, 3, 20))], "fold int, train_end date, test_end date")
    rows = spark.createDataFrame([(date(2024, 3, e), f"2024-03-{f:02d} 06:00:00") for e, f in ((10, 1), (15, 9), (15, 11), (25, 11))], "expiry date, f string").withColumn("pattern_start", F.to_timestamp("f"))
    assert [r["side"] for r in walkforward.fold_side(rows, folds).orderBy("expiry", "f").collect()] == ["train", "purge", "test", "unused"]


def patterns(spark):
    sig = annotate_outcomes(detect.detect_red_squeeze(with_peak_after(chain(spark)))).withColumn("settle_ts", settlement.at_seconds("expiry", 43_200))
    return to_pattern_rows(sig.withColumns({"univ_ratio": F.lit(2.0), "univ_symbol": F.lit("x")}))


def test_look_ahead_is_refused(spark):
    rows = patterns(spark)
    with pytest.raises(guarded.LookAheadError):
        guarded.where_ex_ante(rows, "ratio > 5")
    with pytest.raises(guarded.LookAheadError):
        guarded.where_ex_ante(rows, "nonsense > 5")
    sneaky = guarded.with_derived(rows, [("a", "signal_value * 2"), ("sneaky", "ratio * 2"), ("worse", "sneaky + a")])
    for name in ("sneaky", "worse"):
        with pytest.raises(guarded.LookAheadError):
            guarded.where_ex_ante(sneaky, f"{name} > 1")
    assert guarded.where_ex_ante(sneaky, "a > 1").count() == 1
    assert guarded.mark_success(sneaky, "worse > 1").first()["win"] is True
    with pytest.raises(ValueError):
        guarded.with_derived(rows, [("strike", "1")])


def test_missing_numbers_count_as_zero_in_conditions(spark):
    rows = patterns(spark)
    assert guarded.where_ex_ante(rows, "dist < 1 and strike <> 0").first()["dist"] is None
    assert guarded.where_ex_ante(rows, "strike").count() == 1
    assert one(guarded.unpopulated_fields(rows, ["dist", "strike"]), "field") == [("dist",)]
    with pytest.raises(ValueError):
        guarded.check_floor("red_squeeze", 10, {"red_squeeze": 15})


def test_planted_leak_shows_in_the_gap(spark):
    rows = [(date(2024, 1, e), f"2024-01-{e:02d}", e <= 5) for e in range(1, 11) for _ in range(4)]
    df = spark.createDataFrame(rows, "expiry date, d string, win boolean").withColumn("pattern_start", F.to_timestamp("d"))
    stats = walkforward.walk_forward(walkforward.fold_side(df, walkforward.build_folds(df)), 1).orderBy("fold").collect()
    assert stats[0]["train_pct"] == 100.0 and all(r["test_pct"] == 0.0 for r in stats) and stats[0]["gap"] == 100.0


def test_empty_rerun_clears_the_scope(spark, tmp_path):
    red, p = reds(16, 8, 4, 1)
    c = bars(spark, [(1000, 1001), *red, (p, p + 2), (p, p + 9)])
    settle = c.select("spot", "expiry").distinct().withColumn("settle_ts", settlement.at_seconds("expiry", 43_200))
    found = run_events(c, spots(spark, [5.0] * 9), settle, ids=["red_squeeze"]).drop("settle_ts")
    path, scope = str(tmp_path / "events"), ("red_squeeze", "EVT", "2024-02-01")
    counts = []
    for df in (found, found.where("n > 5"), found):
        results.write_events(df, path, *scope)
        counts.append(results.read_events(spark, path).count())
    assert counts == [1, 0, 1]


def test_full_axis(spark):
    ev = spark.createDataFrame([(0, 12.0, 0.0, "activated"), (3, 1.0, 0.0, "slHit")], "moneyness_bucket int, max_ratio double, univ_ratio double, state string")
    got = report.breakdown(ev, [bands.dim(spark, bands.MONEYNESS_BUCKETS, "moneyness_bucket")], min_sample=1)
    assert got.count() == 11 and got.where("n = 0").count() == 9 and got.where("best").count() == 1


def test_symbols(spark):
    df = spark.createDataFrame([("C-BTC-95000-010124",), ("P-X-bad-1",), ("junk",)], "symbol string")
    assert sorted(one(with_instrument_cols(df), "opt_type", "strike"), key=str) == sorted([("C", 95000.0), ("P", None), (None, None)], key=str)


def test_settlement_fallbacks(spark):
    df = spark.createDataFrame([(s, date(2024, 1, 2)) for s in "abcd"], "spot string, expiry date")
    exact = spark.createDataFrame([("a", date(2024, 1, 2), 1)], "spot string, expiry date, settle_seconds int")
    by_spot = spark.createDataFrame([("a", 2), ("b", 2)], "spot string, settle_seconds int")
    default = spark.createDataFrame([("b", 3), ("c", 3)], "spot string, settle_seconds int")
    got = settlement.with_settlement(df, exact, by_spot, default).withColumn("s", F.unix_seconds("settle_ts") % 86_400)
    assert sorted(one(got, "spot", "s")) == [("a", 1), ("b", 2), ("c", 3), ("d", 43_200)]
