"""Streams give what batches give."""

from pyspark.sql import functions as F

from helpers import bars, reds
from wickwork.operators import detect, indicators
from wickwork.operators.asof import with_spot_bar
from wickwork.operators.outcomes import annotate_outcomes, with_peak_after
from wickwork.sources.scratch import shared_dir
from wickwork.streaming import candles, signals


def run(stream, tmp_path, name):
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-log")).option("path", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def source(spark, df, tmp_path, parts=3):
    """The rows as files that a stream takes one at a time, in order of time."""
    rows, folder = df.orderBy("ts").collect(), tmp_path / "in"
    for k in range(parts):
        piece = rows[len(rows) * k // parts : len(rows) * (k + 1) // parts]
        spark.createDataFrame(piece, df.schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def series(spark):
    red, p = reds(16, 4, 1)
    again, q = reds(9, 4, 2, start=p + 9)
    return bars(spark, [(1000, 1001), *red, (p, p + 2), (p + 2, p + 9), *again, (q, q + 1), (q + 1, q)])


def test_squeeze(spark, tmp_path):
    b = series(spark)
    run(signals.stream_red_squeeze(source(spark, b, tmp_path), min_value=2), tmp_path, "out")
    batch = detect.detect_red_squeeze(with_peak_after(b), min_value=2)
    cols = ["symbol", "entry_ts", "pattern_start", "seq_length", "ratio1", "ratio2", "signal_value"]
    got = spark.read.parquet(str(tmp_path / "out")).select(*cols).orderBy("entry_ts").collect()
    assert got == batch.select(*cols).orderBy("entry_ts").collect() and len(got) == 2


def test_indicators(spark, tmp_path):
    b = series(spark)
    run(signals.stream_indicators(source(spark, b, tmp_path), (3,), (2,)), tmp_path, "out")
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()
    want = indicators.price_volatility(indicators.ema(b, (3,)), (2,)).orderBy("ts").collect()
    for g, w in zip(got, want, strict=True):
        assert (g["ema3"] is None) == (w["ema3"] is None) and abs((g["ema3"] or 0) - (w["ema3"] or 0)) < 1e-9
        assert (g["vol2"] is None) == (w["vol2"] is None) and abs((g["vol2"] or 0) - (w["vol2"] or 0)) < 1e-6


def test_outcomes_follow(spark):
    b = series(spark)
    first = annotate_outcomes(detect.detect_red_squeeze(with_peak_after(b.where("ts < '2024-01-01 06:00:00'")), min_value=2))
    (before,) = first.collect()
    whole = annotate_outcomes(detect.detect_red_squeeze(with_peak_after(b), min_value=2)).orderBy("entry_ts").first()
    (r,) = signals.update_outcomes(first, b).collect()
    assert [r[c] for c in ("state", "ratio", "peak_after", "broke_out")] == [whole[c] for c in ("state", "ratio", "peak_after", "broke_out")]
    # Bars of another symbol, and no bars at all, change nothing.
    for none in (b.withColumn("symbol", F.lit("C-EVT-7-7")), b.limit(0)):
        (same,) = signals.update_outcomes(first, none).collect()
        assert same == before


def test_pending_stays_pending_until_a_bar_comes(spark):
    b = series(spark)
    entry = annotate_outcomes(detect.detect_red_squeeze(with_peak_after(b), min_value=2)).orderBy("entry_ts").first()["entry_ts"]
    upto = b.where(F.col("ts") <= F.lit(entry))
    first = annotate_outcomes(detect.detect_red_squeeze(with_peak_after(upto), min_value=2))
    (row,) = first.collect()
    assert (row["state"], row["peak_after"], row["ratio"]) == ("pending", 0.0, 0.0)
    assert [r["state"] for r in signals.update_outcomes(first, upto).collect()] == ["pending"]
    (r,) = signals.update_outcomes(first, b.withColumn("high", F.lit(0.5))).collect()
    assert r["state"] == "slHit" and r["peak_after"] == 0.5 and 0 < r["ratio"] < 1


def test_every_detector_on_a_stream(spark, tmp_path):
    """Micro-batches of any length fire what the batch fires, each firing once."""
    import random

    from helpers import at

    rng, rows = random.Random(3), []
    shapes = ((-4, -2, -1, 3), (-5, -3, -2, -1, 1), (1, 2, 3, -1), (1, 2, 2, 3, 3, 4, -2), (160,), (-120,), (0,), (-2,), (2, -1), (-1, -1))
    for k, symbol in enumerate(("C-EVT-300-1", "P-EVT-100-2", "C-EVT-250-3")):
        price, moves = 20.0 + k, []
        for i in range(160):
            moves = moves or [m / 4 for m in rng.choice(shapes)]
            new = price + moves.pop(0)
            new = new if 1 < new < 200 else 20.0
            rows.append(("EVT", at(0).date(), 60, symbol, at(i * 60), price, max(price, new), min(price, new), new, 1.0))
            price = new
    b = spark.createDataFrame(rows, "spot string, expiry date, duration int, symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    spot = spark.createDataFrame([("EVT", 60, at(i * 60), 200.0, 210.0, 190.0, 200.0) for i in range(160)], "spot string, duration int, ts timestamp, open double, high double, low double, close double")
    floors = dict.fromkeys(detect.REGISTRY, 0.0) | {"otm_wall": 0.3}
    sink = signals.detector_sink(str(tmp_path / "fired"), str(tmp_path / "open"), spot, min_values=floors)
    cuts, epoch = [0, 3, 9, 10, 40, 41, 90, 160], 0
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        part = b.where((F.col("ts") >= F.lit(at(lo * 60))) & (F.col("ts") < F.lit(at(hi * 60))))
        for _ in range(2 if lo == 41 else 1):
            sink(part, epoch)
        epoch += 1
    cols = ["signal", "symbol", "entry_ts", "pattern_start", "seq_length", "signal_value", "first_body"]
    got = spark.read.parquet(str(tmp_path / "fired")).select(*cols).collect()
    batch = detect.run_detectors(with_spot_bar(with_peak_after(b), spot), None, min_values=floors)
    last = F.lit(at(159 * 60))
    want = batch.where((F.col("signal") != "green_stairs") | (F.col("entry_ts") < last)).select(*cols).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and {r["signal"] for r in got} == set(detect.REGISTRY) and len(got) > 40
    assert spark.read.parquet(str(tmp_path / "open" / f"epoch={epoch - 1}")).count() < 60


def test_snapshot(spark):
    b = series(spark)
    found = annotate_outcomes(detect.detect_red_squeeze(with_peak_after(b), min_value=2))
    settle = b.select("spot", "expiry").distinct().withColumn("settle_ts", F.lit("2024-01-02 03:00:00").cast("timestamp"))
    spot = b.drop("expiry", "symbol")
    (r,) = signals.live_snapshot(b, found, spot, settle, F.lit("2024-01-01 12:15:00").cast("timestamp"), 1).collect()
    assert (r["hours_to_expiry"], r["instruments"], r["durations"], r["n_signals"], len(r["signals"])) == (14.8, 1, [60], 2, 1)
    assert r["signals"][0]["entry_ts"] == max(x["entry_ts"] for x in found.collect()) and r["spot_price"] == b.orderBy(F.desc("ts")).first()["close"]
    (none,) = signals.live_snapshot(b, found.limit(0), spot, settle, F.lit("2024-01-01 12:15:00").cast("timestamp")).collect()
    assert none["n_signals"] == 0 and none["signals"] is None


def test_spot_sink_and_enrichment(spark, tmp_path):
    b = series(spark).drop("expiry", "symbol")
    sink = candles.spot_upsert_sink(str(tmp_path / "spot"))
    sink(b.unionByName(b), 0)
    assert spark.read.parquet(str(tmp_path / "spot")).count() == b.count()
    s = series(spark)
    settle = s.select("spot", "expiry").distinct().withColumn("settle_ts", F.lit("2024-01-01 03:00:00").cast("timestamp"))
    listed = s.select("spot", "expiry", "symbol").distinct().withColumn("product_id", F.lit(1))
    rich = candles.enrich(s, settle, listed)
    assert rich.where("product_id = 1").count() == s.count() and candles.live_only(rich).count() == 3
    assert shared_dir(spark)
