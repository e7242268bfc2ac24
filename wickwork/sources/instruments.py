"""Instruments and settlement times from product lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRODUCT = "symbol string, id bigint, settlement_time string, underlying_asset struct<symbol string>"


def read_products(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PRODUCT).json(path)


def _listed(products: DataFrame) -> DataFrame:
    rows = products.select(F.col("underlying_asset.symbol").alias("spot"), F.substring("settlement_time", 1, 10).try_cast("date").alias("expiry"), "symbol", F.col("id").alias("product_id"), "settlement_time")
    return rows.where("spot is not null and spot <> '' and expiry is not null")


def build_instruments(products: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(spot, expiry, symbol, product_id); a product needs an underlying and a settlement, and replaces an older one of its symbol."""
    new = _listed(products).where("symbol is not null and symbol <> '-'").drop("settlement_time").withColumn("__new", F.lit(1))
    both = new if existing is None else new.unionByName(existing.withColumn("__new", F.lit(0)))
    w = Window.partitionBy("spot", "expiry", "symbol").orderBy(F.desc("__new"), F.desc("product_id"))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__new")


def learn_settlements(products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Settlement times of day in UTC seconds: the newest product's per (spot, expiry), and per spot."""
    at = F.unix_seconds(F.to_timestamp("settlement_time")) % 86_400
    rows = _listed(products).withColumn("settle_seconds", at).where("settle_seconds is not null")
    newest = F.max_by("settle_seconds", F.struct("expiry", "product_id")).alias("settle_seconds")
    return rows.groupBy("spot", "expiry").agg(newest), rows.groupBy("spot").agg(newest)
