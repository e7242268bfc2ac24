"""What a task holds does not grow with the table."""

from pyspark.sql import functions as F

from helpers import bars
from wickwork.operators import detect, rollup
from wickwork.operators.outcomes import with_peak_after
from wickwork.operators.rollup import gapless
from wickwork.plans import views

plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def line_items(spark, path, n):
    rows = spark.range(n).select(
        F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") % 40).alias("l_suppkey"), F.lit(2.0).alias("l_quantity"),
        (F.col("id") % 17 + 1.0).alias("l_extendedprice"), F.timestamp_seconds(F.floor(F.col("id") / 40) * 86_400).alias("l_shipdate"),
    )
    rows.write.parquet(f"{path}/lineitem.parquet")
    return path


def test_supplier_series_take_more_tasks_as_they_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rollup, "TASK_ROWS", 200)
    for n in (1000, 4000):
        d = line_items(spark, str(tmp_path / str(n)), n)
        candles = views.supplier_series(spark, d)
        found = detect.detect_red_squeeze(with_peak_after(gapless(candles)))
        assert candles.rdd.getNumPartitions() == found.rdd.getNumPartitions() == n // 200 and candles.count() == n
        per = candles.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        assert per < n / 2
        # Items are dealt before they are grouped, bars once more for all windows.
        assert plan_of(found).count("Exchange hashpartitioning") == 2 and "SortAggregate" not in plan_of(found)


def test_gapless_and_peaks_share_a_sort(spark):
    b = bars(spark, [(5, 9, 4, 6), (7, 8, 2, 3), (3, 9, 3, 5), (5, 5, 1, 2), (4, 7, 4, 7)])
    rows = with_peak_after(gapless(b))
    assert plan_of(rows).count("Sort [") == 1
    got = [(r["open"], r["high"], r["low"], r["peak_after"], r["peak_bars"]) for r in rows.orderBy("ts").collect()]
    assert got == [(5, 9, 4, 9, 2), (6, 8, 2, 9, 1), (3, 9, 3, 7, 2), (5, 5, 1, 7, 1), (2, 7, 2, None, None)]
