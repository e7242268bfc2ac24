"""Readers and writers round trip; upserts and work lists."""

import json
from datetime import date

from pyspark.sql import functions as F

from helpers import at, bars, spots
from wickwork.operators import settlement, work
from wickwork.sources import candles, instruments, results, tables
from wickwork.sources.scratch import shared_dir


def test_pages_and_compact_arrays(spark, tmp_path):
    bar = {"time": 1_704_067_200, "open": "1.5", "high": "2", "low": "1", "close": "x", "volume": "3"}
    (tmp_path / "page.json").write_text(json.dumps({"symbol": "C-EVT-1-1", "resolution": "1h", "result": [bar, bar]}))
    (r,) = candles.read_candle_pages(spark, str(tmp_path / "page.json")).collect()
    assert (r["duration"], r["open"], r["close"], r["volume"]) == (60, 1.5, None, 3.0)
    folder = tmp_path / "compact/EVT/2024-02-01/60"
    folder.mkdir(parents=True)
    (folder / "C-EVT-1-1.json").write_text("[[1704067200,1,2,0.5,1.5,7],[1704070800,1,2,0.5,1.5,8]]")
    got = candles.read_compact_candles(spark, str(tmp_path / "compact")).orderBy("ts").collect()
    assert [(r["spot"], r["expiry"], r["duration"], r["symbol"], r["low"], r["volume"]) for r in got] == [("EVT", date(2024, 2, 1), 60, "C-EVT-1-1", 0.5, v) for v in (7.0, 8.0)]


def test_candle_table(spark, tmp_path):
    path = str(tmp_path / "candles")
    candles.write_candles(bars(spark, [(1, 2)]), path)
    candles.write_candles(bars(spark, [(3, 4)], expiry=date(2024, 3, 1)), path)
    candles.write_candles(bars(spark, [(3, 4)]).where("false"), path)
    assert candles.read_candles(spark, path).count() == 2
    assert candles.read_candles(spark, str(tmp_path / "nothing")).count() == 0
    assert tables.list_inventory(candles.read_candles(spark, path), ["spot", "expiry"]).count() == 2


def test_spot_upsert(spark, tmp_path):
    path = str(tmp_path / "spot")
    candles.upsert_spot(spots(spark, [1.0] * 30), path)
    new = spots(spark, [2.0] * 3).withColumn("ts", F.timestamp_seconds(F.unix_seconds("ts") + 86_400))
    candles.upsert_spot(new, path)
    got = candles.read_spot(spark, path, "EVT", 60, "2024-01-01", "2024-01-02")
    assert got.count() == 30 and got.where("close = 2").count() == 3
    assert candles.read_spot(spark, path, "EVT", 60, "2024-01-02", "2024-01-02").count() == 6


def test_products(spark, tmp_path):
    rows = [
        {"symbol": "C-EVT-1-1", "id": 1, "settlement_time": "2024-02-01T12:00:00Z", "underlying_asset": {"symbol": "EVT"}},
        {"symbol": "C-EVT-1-1", "id": 2, "settlement_time": "2024-02-01T08:00:00Z", "underlying_asset": {"symbol": "EVT"}},
        {"symbol": "-", "id": 3, "settlement_time": "2024-02-02T12:00:00Z", "underlying_asset": {"symbol": "EVT"}},
        {"symbol": "P-EVT-1-1", "id": 4, "settlement_time": None, "underlying_asset": {"symbol": "EVT"}},
    ]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, rows)))
    products = instruments.read_products(spark, str(tmp_path / "p.json"))
    first = instruments.build_instruments(products)
    assert [(r["symbol"], r["product_id"]) for r in first.collect()] == [("C-EVT-1-1", 2)]
    old = spark.createDataFrame([("EVT", date(2024, 2, 1), s, 9) for s in ("C-EVT-1-1", "C-EVT-2-1")], "spot string, expiry date, symbol string, product_id bigint")
    assert sorted((r["symbol"], r["product_id"]) for r in instruments.build_instruments(products, old).collect()) == [("C-EVT-1-1", 2), ("C-EVT-2-1", 9)]
    exact, spot = instruments.learn_settlements(products)
    assert {r["expiry"]: r["settle_seconds"] for r in exact.collect()} == {date(2024, 2, 1): 28_800, date(2024, 2, 2): 43_200}
    assert [r["settle_seconds"] for r in spot.collect()] == [43_200]


def test_snapshots_and_pruning(spark, tmp_path):
    path = str(tmp_path / "snap")
    sink = results.write_snapshot(path)
    sink(bars(spark, [(1, 2), (2, 3)]), 0)
    sink(bars(spark, [(1, 2)]), 1)
    stored = spark.read.parquet(path)
    assert stored.count() == 1
    settle = stored.select("spot", "expiry").withColumn("settle_ts", settlement.at_seconds("expiry", 0))
    assert results.prune_settled(stored, settle, F.lit("2024-01-31").cast("timestamp")).count() == 1
    assert results.prune_settled(stored, settle, F.lit("2024-02-02").cast("timestamp")).count() == 0


def test_work_lists(spark):
    pairs = spark.createDataFrame([("EVT", date(2024, 1, d), d < 5) for d in range(1, 7)], "spot string, expiry date, settled boolean")
    have = pairs.where("day(expiry) <= 3").select("spot", "expiry")
    done = pairs.where("day(expiry) <= 1").select("spot", "expiry")
    todo, lacking = work.work_list(pairs, have, done, "signals")
    assert [r["expiry"].day for r in todo.collect()] == [3, 2] and [r["expiry"].day for r in lacking.collect()] == [4]
    assert work.work_list(pairs, have, done, "signals", force=True)[0].count() == 3
    assert [r["expiry"].day for r in work.work_list(pairs, have, done, "candles")[0].collect()] == [4]
    listed = spark.createDataFrame([("EVT", date(2024, 1, 1), s) for s in "ab"], "spot string, expiry date, symbol string")
    assert [r["symbol"] for r in work.pending_symbols(listed, listed.where("symbol = 'a'")).collect()] == ["b"]
    (r,) = work.completeness(listed.withColumn("ok", F.col("symbol") == "a")).collect()
    assert (r["complete"], r["failed"]) == (False, 1)


def test_scratch_is_the_session_folder(spark):
    assert shared_dir(spark) == spark.sparkContext.getCheckpointDir()
    assert at(0).year == 2024
