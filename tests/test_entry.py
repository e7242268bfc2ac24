"""The driver's contract, and registered queries against their SQL on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
SOME = ["ohlcv_60m", "ohlcv_multi", "daily_bars_supplier", "asof_spot", "green_stairs", "otm_wall", "universe_further_otm", "merge_events", "hit_tree", "walk_forward", "best_trade", "stream_candles", "supplier_squeeze", "outcomes_multi", "spot_by_duration", "candle_pages", "compact_candles", "settlements_learned", "scalar_functions", "sql_functions", "stream_signals", "stream_outcomes", "live_snapshot", "alive_expiries_at", "loose_equality", "clustered_candles", "stream_followed"]


def plain(v):
    if v is None or v != v:
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = [[plain(v) for v in r] for r in df.select(*cols).collect()]
    want = [[plain(v) for v in r] for r in con.execute(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]})").fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)
