"""Ordered bands and the three ways to look a value up in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INF = float("inf")

#: Fixed values: (label, lower edge, upper edge) or (label, upper edge).
RATIO_BANDS = [("<2x", 0, 2), ("2-5x", 2, 5), ("5-10x", 5, 10), ("10-50x", 10, 50), ("50x+", 50, INF)]
STRENGTH_BANDS = {
    "red_squeeze": [("15-25", 0, 25), ("25-40", 25, 40), ("40-80", 40, 80), ("80-200", 80, 200), ("200+", 200, INF)],
    "otm_red_squeeze": [
        ("1-5k (20-100)", 0, 5000), ("5-25k (4-20)", 5000, 25000), ("25-100k (1-4)", 25000, 100000),
        ("100-250k (<1)", 100000, 250000), ("250k+ (<0.4)", 250000, INF),
    ],
    "otm_wall": [("2-2.5", 0, 2.5), ("2.5-3", 2.5, 3), ("3-4", 3, 4), ("4-6", 4, 6), ("6+", 6, INF)],
}
STRENGTH_BANDS["green_stairs"] = STRENGTH_BANDS["otm_red_squeeze"]
TTE_BUCKETS = [("0-6h", 6), ("6-48h", 48), ("48-120h", 120), ("120-480h", 480), ("480h+", INF)]
MONEYNESS_BUCKETS = [
    ("12.5%+ ITM", -12.5), ("9-12.5% ITM", -9), ("6-9% ITM", -6), ("3.5-6% ITM", -3.5), ("1.5-3.5% ITM", -1.5), ("±1.5%", 1.5),
    ("1.5-3.5% OTM", 3.5), ("3.5-6% OTM", 6), ("6-9% OTM", 9), ("9-12.5% OTM", 12.5), ("12.5%+ OTM", INF),
]
EMA_SPREAD_BANDS = [(">1%", INF), ("1% - 0.1%", 1), ("0.1% - 0.01%", 0.1), ("0.01%-0.001%", 0.01), ("<0.001%", 0.001)]
VOLATILITY_BANDS = [("very low", 0.01), ("low", 0.05), ("moderate", 0.2), ("high", 1), ("very high", INF)]
THRESHOLDS, HEADLINE, MIN_SAMPLE = (5, 10, 50, 100), 10, 30


def strength_bands(signal: str) -> list:
    """Bands of a signal; unknown signals use those of red_squeeze."""
    return STRENGTH_BANDS.get(signal, STRENGTH_BANDS["red_squeeze"])


def _case(tests: list[tuple[Column, int]], last: int, value: Column) -> Column:
    out = F.when(value.isNull(), None)
    for test, i in tests:
        out = out.when(test, i)
    return out.otherwise(last)


def band_range(value: Column, bands: list) -> Column:
    """Index of the first band with lower edge <= value < upper edge; the last one if none."""
    return _case([((value >= lo) & (value < hi), i) for i, (_, lo, hi) in enumerate(bands)], len(bands) - 1, value)


def bucket_first(value: Column, bands: list) -> Column:
    """Index of the first band whose upper edge is above the value; the last one if none."""
    return _case([(value < b[-1], i) for i, b in enumerate(bands)], len(bands) - 1, value)


def band_tightest(value: Column, bands: list) -> Column:
    """Index of the band with the smallest upper edge above the value, in whatever order bands stand."""
    order = sorted(range(len(bands)), key=lambda i: bands[i][-1])
    return _case([(value < bands[i][-1], i) for i in order], order[-1], value)


def band_label(index: Column, bands: list) -> Column:
    return F.get(F.array(*[F.lit(b[0]) for b in bands]), index)


def dim(spark: SparkSession, bands: list, name: str) -> DataFrame:
    """(name, name_label) rows of a band list, as an axis."""
    return spark.createDataFrame([(i, b[0]) for i, b in enumerate(bands)], f"{name} int, {name}_label string")
