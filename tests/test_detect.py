"""Patterns and outcomes on golden cases and against plain state machines."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import bars, reds, spots
from wickwork.operators import detect
from wickwork.operators.outcomes import annotate_outcomes, with_peak_after

DUMMY = (1000.0, 1001.0)


def squeeze(spark, rows, **how):
    return annotate_outcomes(detect.detect_red_squeeze(with_peak_after(bars(spark, rows)), **how)).collect()


def test_red_squeeze_fires(spark):
    rows, p = reds(16, 4, 1)
    (r,) = squeeze(spark, [DUMMY, *rows, (p, p + 2)])
    assert (r["ratio1"], r["ratio2"], r["signal_value"], r["seq_length"]) == (16, 8, 16, 3)
    assert r["state"] == "pending" and r["ratio"] == 0


def test_red_squeeze_restarts_at_a_larger_body(spark):
    rows, p = reds(3, 5, 4, 2)
    (r,) = squeeze(spark, [DUMMY, *rows, (p, p + 1)], min_value=0)
    assert r["seq_length"] == 3 and r["first_body"] == 5


def test_flat_bar_breaks(spark):
    rows, p = reds(5, 4)
    assert squeeze(spark, [DUMMY, *rows, (p, p), (p, p - 3), (p - 3, p)], min_value=0) == []


def test_first_bar_takes_no_part(spark):
    rows, p = reds(5, 4, 3)
    assert squeeze(spark, [*rows, (p, p + 1), (p, p)], min_value=0) == []


@pytest.mark.parametrize(("later", "state", "ratio"), [(320, "activated", 3.048), (105, "slHit", 1.0), (None, "pending", 0.0)])
def test_outcomes(spark, later, state, ratio):
    rows, p = reds(16, 4, 1, start=122)
    entry = (p, 105.0, p, p + 0.5)
    after = [] if later is None else [(100, later, 90, 100)]
    (r,) = squeeze(spark, [(122, 123), *rows, entry, *after])
    assert (r["state"], r["ratio"]) == (state, ratio)


def test_green_stairs_equal_budget(spark):
    p, rows = 10.0, [(10.0, 9.0)]
    for b in (1, 2, 2, 3, 3, 4):
        rows.append((p, p + b))
        p += b
    found = detect.detect_green_stairs(with_peak_after(bars(spark, rows)), spots(spark, [50.0] * len(rows)), min_value=0).collect()
    assert [(r["seq_length"], r["equal_steps"], r["entry_price"]) for r in found] == [(4, 1, 18.0)]


def machine(rows, max_equal=1, min_seq=3):
    """Both run patterns by plain rules: (kind, entry, length)."""
    out, run, seq, equal = [], [], [], 0
    for i, (o, c) in enumerate(rows):
        b, green = abs(c - o), c > o
        if i and c < o:
            run = [*run, b] if run and b < run[-1] else [b]
        elif i:
            if green and len(run) >= min_seq:
                out.append(("red", i, len(run)))
            run = []
        if not i:
            continue
        goes = green and (not seq or b > seq[-1] or (b == seq[-1] and equal < max_equal))
        if goes:
            equal += bool(seq) and b == seq[-1]
            seq.append(b)
        else:
            if len(seq) >= min_seq:
                out.append(("green", i - 1, len(seq)))
            seq, equal = ([b], 0) if green else ([], 0)
    if len(seq) >= min_seq:
        out.append(("green", len(rows) - 1, len(seq)))
    return sorted(out)


@pytest.mark.parametrize("max_equal", [0, 1, 2])
def test_windows_equal_state_machines(spark, max_equal):
    rng, table, want = random.Random(max_equal), None, {}
    for s in range(24):
        rows = [(100.0, 100.0 + rng.choice((-3, -2, -1, -1, 0, 1, 1, 2, 2, 3, 4))) for _ in range(rng.randint(6, 40))]
        symbol = f"C-EVT-{200 + s}-1"
        want[symbol] = machine(rows, max_equal)
        one = bars(spark, rows, symbol)
        table = one if table is None else table.unionByName(one)
    table, spot = with_peak_after(table).cache(), spots(spark, [100.0] * 50)
    red = detect.detect_red_squeeze(table, min_value=0)
    green = detect.detect_green_stairs(table, spot, min_value=0, max_equal=max_equal)
    got = {k: [] for k in want}
    for kind, found in (("red", red), ("green", green)):
        for r in found.select("symbol", F.unix_seconds("entry_ts").alias("t"), "seq_length").collect():
            got[r["symbol"]].append((kind, (r["t"] - 1_704_067_200) // 3600, r["seq_length"]))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_otm_wall_jumps(spark):
    quiet = [(10.0, 10.0 + 0.01 * (i % 2)) for i in range(12)]
    rows = [*quiet, (10.0, 60.0), (60.0, 59.0)]
    found = detect.detect_otm_wall(with_peak_after(bars(spark, rows)), spots(spark, [50.0] * 20)).collect()
    assert len(found) == 1 and found[0]["entry_price"] == 60.0 and found[0]["signal_value"] >= 2


def test_registry(spark):
    assert list(detect.select_detectors(["otm_wall"])) == ["otm_wall"]
    with pytest.raises(KeyError):
        detect.select_detectors(["nothing"])
