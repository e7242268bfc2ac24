"""Partitioned Parquet tables: scoped overwrites, upserts and listings.

Dynamic partition overwrite replaces the partitions that new rows fall in and
leaves the others; a scope that must also lose partitions without new rows is
replaced as a whole.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from wickwork.sources.scratch import cut, folder


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace the partitions that `df` has rows in; an empty table writes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The table, or an empty one of that schema where nothing is stored yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_scope(df: DataFrame, path: str, scope: dict[str, str], by: list[str]) -> None:
    """Make `df` all that is stored for `scope`, the leading partition columns: an empty table removes what was there."""
    spark = df.sparkSession
    at = path + "".join(f"/{k}={v}" for k, v in scope.items())
    rest = [c for c in by if c not in scope]
    # Worked out once, for the test and for the write; the rows may come from the very scope that is replaced.
    rows = cut(df.drop(*scope), "scope")
    if rows.isEmpty():
        fs, gone = folder(spark, at)
        fs.delete(gone, True)
    else:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*rest).parquet(at)


def list_inventory(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values in order; over partition columns alone Spark reads no data."""
    return df.select(*columns).distinct().orderBy(*columns)


def replace_where(df: DataFrame, path: str, keys: list[str], by: list[str], schema: T.StructType | str) -> None:
    """Replace the stored rows of the keys that `df` has, inside the partitions it touches, and keep the others there."""
    spark = df.sparkSession
    parts = df.select(*by).distinct()
    kept = read_table(spark, path, schema).join(parts, by, "left_semi").join(df.select(*keys).distinct(), keys, "left_anti")
    # Read before the partitions are replaced; the folder is shared, so the copy survives lost executors.
    rows = cut(kept.unionByName(df), "replace")
    write_partitioned(rows, path, by)


__all__ = ["list_inventory", "read_table", "replace_where", "write_partitioned", "write_scope"]
