"""State that ends at settlement, corrected bars, followed signals, and a pass that is published as one."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import at, bars, reds
from wickwork.functions.candles import SERIES
from wickwork.operators import detect
from wickwork.operators.asof import with_spot_bar
from wickwork.operators.outcomes import annotate_outcomes, with_peak_after
from wickwork.streaming import outcomes, signals
from wickwork.streaming.state import final_bars, first_needed, rocksdb, with_open_bars

NAMES = "spot string, expiry date, duration int, symbol string, ts timestamp, open double, high double, low double, close double, volume double"
FLOORS = dict.fromkeys(detect.REGISTRY, 0.0) | {"otm_wall": 0.3}
SETTLE = 200


def many(spark, n=160):
    rng, rows = random.Random(3), []
    shapes = ((-4, -2, -1, 3), (-5, -3, -2, -1, 1), (1, 2, 3, -1), (1, 2, 2, 3, 3, 4, -2), (160,), (-120,), (0,), (-2,), (2, -1), (-1, -1))
    for k, symbol in enumerate(("C-EVT-300-1", "P-EVT-100-2", "C-EVT-250-3")):
        price, moves = 20.0 + k, []
        for i in range(n):
            moves = moves or [m / 4 for m in rng.choice(shapes)]
            new = price + moves.pop(0)
            new = new if 1 < new < 200 else 20.0
            rows.append(("EVT", at(0).date(), 60, symbol, at(i * 60), price, max(price, new), min(price, new), new, 1.0))
            price = new
    return spark.createDataFrame(rows, NAMES)


def spots(spark, n=160):
    return spark.createDataFrame([("EVT", 60, at(i * 60), 200.0, 210.0, 190.0, 200.0) for i in range(n)], "spot string, duration int, ts timestamp, open double, high double, low double, close double")


def settles(spark, b):
    return b.select("spot", "expiry").distinct().withColumn("settle_ts", F.lit(at(SETTLE * 60)).cast("timestamp"))


def feed(spark, parts, folder):
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def slices(b, cuts):
    return [b.where((F.col("ts") >= F.lit(at(lo * 60))) & (F.col("ts") < F.lit(at(hi * 60)))) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def go(stream, log, sink=None, path=None):
    w = stream.writeStream.option("checkpointLocation", str(log)).trigger(availableNow=True)
    (w.foreachBatch(sink) if sink else w.format("parquet").option("path", str(path))).start().awaitTermination()


def wanted(b, spot, last):
    cols = ["signal", "symbol", "entry_ts", "pattern_start", "seq_length", "signal_value", "first_body"]
    batch = detect.run_detectors(with_spot_bar(with_peak_after(b), spot), None, min_values=FLOORS)
    return sorted(map(str, batch.where((F.col("signal") != "green_stairs") | (F.col("entry_ts") < F.lit(last))).select(*cols).collect())), cols


def live(spark, b, folder, cuts, more=()):
    with_settle = b.join(settles(spark, b), ["spot", "expiry"])
    return feed(spark, [*slices(with_settle, cuts), *more], folder).withWatermark("ts", "1 hour")


def test_state_is_gone_after_settlement(spark, tmp_path):
    b, spot = many(spark), spots(spark)
    # Another chain goes on after the first one has settled.
    later = bars(spark, [(5, 6)] * 3, "C-OTH-5-1", spot="OTH").withColumn("ts", F.expr(f"ts + interval {SETTLE + 30} hours")).withColumn("settle_ts", F.lit(at(900 * 60)).cast("timestamp"))
    cuts = [0, 9, 10, 90, 160]
    log, out = tmp_path / "log", str(tmp_path / "fired")
    held = lambda: spark.read.format("statestore").option("path", str(log)).option("stateVarName", "bars").load()
    with rocksdb(spark):
        go(with_open_bars(live(spark, b, tmp_path / "in", cuts)), log, signals.firing_sink(out, spot, min_values=FLOORS))
        want, cols = wanted(b, spot, at(159 * 60))
        assert sorted(map(str, spark.read.parquet(out).select(*cols).collect())) == want and len(want) > 40
        assert {r["key"]["symbol"] for r in held().collect()} == {r["symbol"] for r in b.select("symbol").distinct().collect()} and held().count() < 60
        stream = feed(spark, [later.select(*b.columns, "settle_ts")], tmp_path / "in").withWatermark("ts", "1 hour")
        go(with_open_bars(stream), log, signals.firing_sink(out, spot, min_values=FLOORS))
        assert {r["key"]["symbol"] for r in held().collect()} == {"C-OTH-5-1"}


def test_indicator_state_is_gone_after_settlement(spark, tmp_path):
    b = many(spark, 20)
    later = b.limit(1).withColumns({"symbol": F.lit("x"), "ts": F.lit(at(900 * 60)).cast("timestamp"), "settle_ts": F.lit(at(9000 * 60)).cast("timestamp")})
    first = b.join(settles(spark, b), ["spot", "expiry"])
    stream = feed(spark, [first, later.select(*first.columns), later.select(*first.columns).withColumn("ts", F.lit(at(901 * 60)).cast("timestamp"))], tmp_path / "in").withWatermark("ts", "1 hour")
    go(signals.stream_indicators(stream, (3,), (2,)), tmp_path / "log", path=tmp_path / "out")
    assert [r["key"]["symbol"] for r in spark.read.format("statestore").option("path", str(tmp_path / "log")).load().collect()] == ["x"]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 62


def test_the_first_bar_needed():
    import numpy as np

    red, p = reds(9, 4, 2)
    rows = [(5.0, 6.0)] * 12 + [(float(a), float(b)) for a, b in red]
    o, c = (np.array(x) for x in zip(*rows, strict=True))
    assert first_needed(o, c) == len(rows) - 9 and first_needed(o[:3], c[:3]) == 0
    falling = np.arange(40, 0, -1.0)
    assert first_needed(falling, falling - 1) == 0


def test_detector_sink_drops_settled_chains(spark, tmp_path):
    b, spot = many(spark, 30), spots(spark)
    other = bars(spark, [(5, 6)] * 3, "C-OTH-5-1", spot="OTH").withColumn("ts", F.expr("ts + interval 900 hours"))
    known = settles(spark, b).unionByName(settles(spark, other).withColumn("settle_ts", F.lit(at(9000 * 60)).cast("timestamp")))
    sink = signals.detector_sink(str(tmp_path / "f"), str(tmp_path / "o"), spot, min_values=FLOORS, settlements=known)
    sink(b, 0)
    sink(other, 1)
    assert {r["spot"] for r in spark.read.parquet(str(tmp_path / "o" / "epoch=1")).collect()} == {"OTH"}
    # Of two bars of a time the new one counts.
    sink(other.withColumn("close", F.lit(7.0)), 2)
    assert {r["close"] for r in spark.read.parquet(str(tmp_path / "o" / "epoch=2")).collect()} == {7.0}


@pytest.mark.parametrize("swap", [False, True])
def test_corrections_in_any_order(spark, tmp_path, swap):
    b = many(spark, 60)
    wrong = b.where("minute(ts) = 0 and hour(ts) % 4 = 1").withColumns({"close": F.col("close") * 1.5, "volume": F.lit(0.5)})
    first, second = (wrong, b) if swap else (b, wrong)
    cuts = [0, 20, 40, 60]
    parts = [p for x, y in zip(slices(first, cuts), slices(second, cuts), strict=True) for p in (x, y, x)]
    go(final_bars(feed(spark, parts, tmp_path / "in"), "30 hours"), tmp_path / "log", path=tmp_path / "out")
    got = spark.read.parquet(str(tmp_path / "out")).select(*b.columns)
    want = b.where(F.col("ts") < F.lit(at(29 * 60)))
    assert sorted(map(str, got.where(F.col("ts") < F.lit(at(29 * 60))).collect())) == sorted(map(str, want.collect())) and got.count() <= want.count() + 3
    assert got.groupBy("symbol", "ts").count().where("count > 1").isEmpty()


def test_followed_signals_equal_updated_ones(spark, tmp_path):
    b = many(spark)
    found = annotate_outcomes(detect.detect_red_squeeze(with_peak_after(b.where(F.col("ts") < F.lit(at(60 * 60)))), min_value=0.0)).select(*SERIES, "signal", "entry_ts", "trigger_high", "state", "ratio", "peak_after")
    later = b.where(F.col("ts") >= F.lit(at(60 * 60)))
    parts = slices(later, [60, 61, 100, 160])
    stream = outcomes.later_bars(feed(spark, [found], tmp_path / "signals"), feed(spark, parts, tmp_path / "bars"))
    go(stream, tmp_path / "log", outcomes.peak_sink(str(tmp_path / "peaks")))
    got = outcomes.followed_outcomes(found, str(tmp_path / "peaks"))
    assert sorted(map(str, got.collect())) == sorted(map(str, signals.update_outcomes(found, later).collect())) and found.count() > 5
    assert got.where("state = 'activated'").count() > found.where("state = 'activated'").count()


def passes(spark, path):
    shape = {"signals": None, "board": None, "points": None}
    for name in shape:
        folder = f"{path}/{name}/epoch={outcomes.published(spark, path)[-1]}"
        shape[name] = sorted(map(str, outcomes.read_pass(spark, path, name, spark.read.parquet(folder).schema).collect()))
    return shape


def test_a_pass_is_published_as_one(spark, tmp_path, monkeypatch):
    """A stream that dies between its tables and their marker, then starts again, leaves what an undisturbed one leaves."""
    b, spot, cuts = many(spark), spots(spark), [0, 40, 90, 160]
    known = settles(spark, b)
    assert outcomes.published(spark, str(tmp_path / "none")) == []
    with rocksdb(spark):
        go(with_open_bars(live(spark, b, tmp_path / "in", cuts)), tmp_path / "log", outcomes.live_pass_sink(str(tmp_path / "a"), spot, known, min_values=FLOORS, points=5))
        sink, dying = outcomes.live_pass_sink(str(tmp_path / "b"), spot, known, min_values=FLOORS, points=5), []
        real = outcomes._stamp

        def stamp(session, path, epoch):
            if epoch == 1 and not dying:
                dying.append(epoch)
                raise RuntimeError("killed")
            return real(session, path, epoch)

        monkeypatch.setattr(outcomes, "_stamp", stamp)
        stream = spark.readStream.schema(b.join(known, ["spot", "expiry"]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
        with pytest.raises(Exception, match="killed"):
            go(with_open_bars(stream), tmp_path / "log2", sink)
        assert outcomes.published(spark, str(tmp_path / "b")) == [0]
        go(with_open_bars(stream), tmp_path / "log2", sink)
    assert dying and passes(spark, str(tmp_path / "a")) == passes(spark, str(tmp_path / "b"))
    got = passes(spark, str(tmp_path / "a"))
    assert len(got["signals"]) == len(wanted(b, spot, at(159 * 60))[0]) and len(got["points"]) == 15 and len(got["board"]) == 1
