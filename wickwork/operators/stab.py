"""Stabbing join: which intervals hold which moments, by equal time buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stab_join(intervals: DataFrame, moments: DataFrame, start: str, end: str, at: str = "at", bucket_hours: int = 24) -> DataFrame:
    """Rows of `intervals` for each row of `moments` with start <= at < end.

    An interval stands in each bucket that it touches and a moment in one, so
    both meet by equal keys; buckets should be of the order of the intervals. A
    moment that many intervals share, or a bucket of many moments, is split by
    adaptive execution like any other key. Empty intervals and null times hold
    and are held by nothing.
    """
    size = bucket_hours * 3600
    of = lambda c: F.floor(F.unix_micros(c) / (size * 1_000_000)).cast("bigint")
    wide = intervals.where(F.col(start) < F.col(end)).withColumn("__b", F.explode(F.sequence(of(start), of(end))))
    dots = moments.where(F.col(at).isNotNull()).withColumn("__b", of(at))
    return wide.join(dots, "__b").where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("__b")
