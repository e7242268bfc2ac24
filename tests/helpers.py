"""Small tables for tests."""

from datetime import UTC, date, datetime, timedelta

START = datetime(2024, 1, 1, tzinfo=UTC)
BARS = "spot string, expiry date, duration int, symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def at(minutes: float) -> datetime:
    return START + timedelta(minutes=minutes)


def bars(spark, rows, symbol="C-EVT-100-1", duration=60, expiry=date(2024, 2, 1), spot="EVT"):
    """Candles from (open, high, low, close) or (open, close), one after the other."""
    out = []
    for i, r in enumerate(rows):
        o, h, l, c = r if len(r) == 4 else (r[0], max(r), min(r), r[1])
        out.append((spot, expiry, duration, symbol, at(i * duration), float(o), float(h), float(l), float(c), 1.0))
    return spark.createDataFrame(out, BARS)


def spots(spark, closes, duration=60, spot="EVT", shift=0):
    return bars(spark, [(c, c) for c in closes], "x", duration, spot=spot).drop("expiry", "symbol").selectExpr("*", f"ts + make_interval(0,0,0,0,0,{shift}) as t2").drop("ts").withColumnRenamed("t2", "ts")


def reds(*bodies, start=1000.0):
    """Falling bars of the given bodies, from one price on."""
    out = []
    for b in bodies:
        out.append((start, start - b))
        start -= b
    return out, start
