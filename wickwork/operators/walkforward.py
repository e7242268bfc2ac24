"""Walk-forward folds with purging, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickwork.functions.bands import MIN_SAMPLE
from wickwork.functions.scalars import half_up
from wickwork.functions.timegrid import ist

#: Number of folds, share of expiries before the first test, share of a single split.
FOLDS, FIRST_TRAIN, SINGLE = 3, 0.5, 0.7


def build_folds(expiries: DataFrame) -> DataFrame:
    """(fold, train_end, test_end) over the distinct expiries: three expanding folds, or one split if there are fewer than six.

    There is one row per expiry, numbered once; edges are looked up by number.
    """
    w = Window.partitionBy(F.lit(1)).orderBy("expiry")
    every = expiries.select("expiry").where("expiry is not null").distinct()
    rows = every.withColumns({"i": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy(F.lit(1)))})
    size = rows.agg(F.max("n").alias("n")).where("n is not null")
    few = F.col("n") < 2 * FOLDS
    first = F.greatest(F.lit(1), F.floor(F.col("n") * FIRST_TRAIN))
    each = F.greatest(F.lit(1), F.floor((F.col("n") - first) / FOLDS))
    fold = F.explode(F.sequence(F.lit(1), F.when(few, 1).otherwise(FOLDS)))
    plan = size.withColumn("fold", fold).withColumn("a", F.when(few, F.floor(F.col("n") * SINGLE)).otherwise(first + (F.col("fold") - 1) * each))
    plan = plan.withColumn("b", F.when(few | (F.col("fold") == FOLDS), F.col("n")).otherwise(F.col("a") + each))
    # A split of too few expiries still trains on the first of them.
    plan = plan.select("fold", F.greatest(F.lit(1), "a").alias("a"), "b")
    train = rows.select(F.col("i").alias("a"), F.col("expiry").alias("train_end"))
    test = rows.select(F.col("i").alias("b"), F.col("expiry").alias("test_end"))
    return plan.join(train, "a").join(test, "b").select("fold", "train_end", "test_end")


def fold_side(rows: DataFrame, folds: DataFrame, fired: Column | str = "pattern_start") -> DataFrame:
    """Rows times folds with `side`: train, test, purge (fired by the end of training but settles in the test) or unused. Folds are three at most."""
    day = F.to_date(ist(fired))
    side = F.when(F.col("expiry") <= F.col("train_end"), "train").when(F.col("expiry") > F.col("test_end"), "unused").when(day <= F.col("train_end"), "purge").otherwise("test")
    return rows.crossJoin(F.broadcast(folds)).withColumn("side", side)


def walk_forward(sided: DataFrame, min_sample: int = MIN_SAMPLE) -> DataFrame:
    """Per fold: n, wins and share of both sides, purged rows, the gap between the shares, and thin (a test side under min_sample)."""
    is_ = lambda s: F.col("side") == s
    grouped = sided.groupBy("fold", "train_end", "test_end").agg(
        F.count_if(is_("train")).alias("train_n"), F.count_if(is_("train") & F.col("win")).alias("train_wins"),
        F.count_if(is_("test")).alias("test_n"), F.count_if(is_("test") & F.col("win")).alias("test_wins"), F.count_if(is_("purge")).alias("purged"),
    )
    pct = lambda s: F.when(F.col(f"{s}_n") > 0, half_up(F.col(f"{s}_wins") * 100.0 / F.col(f"{s}_n"), 1))
    rows = grouped.withColumns({"train_pct": pct("train"), "test_pct": pct("test")})
    return rows.withColumns({"gap": half_up(F.col("train_pct") - F.col("test_pct"), 1), "thin": F.col("test_n") < min_sample})


def oos_summary(stats: DataFrame) -> DataFrame:
    """Mean and spread of the test shares over folds that are not thin."""
    share = F.when(~F.col("thin"), F.col("test_pct"))
    return stats.agg(half_up(F.avg(share), 1).alias("oos_mean"), half_up(F.max(share) - F.min(share), 1).alias("oos_spread"), F.count(share).alias("folds"))


def evaluate(events: DataFrame, success: Column) -> DataFrame:
    """Successes, failures and the share of successes."""
    ok = F.coalesce(success, F.lit(False))
    rows = events.agg(F.count("*").alias("n"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"))
    return rows.withColumn("pct", F.when(F.col("n") > 0, half_up(F.col("successes") * 100.0 / F.col("n"), 1)).otherwise(0.0))


def top_units(units: DataFrame, payoff: str = "ratio", limit: int = 200, symbols: int = 10) -> DataFrame:
    """The best `limit` successes by payoff and the worst failures, with at most `symbols` symbols each."""
    sign = F.when(F.col("win"), -F.col(payoff)).otherwise(F.col(payoff))
    nth = F.row_number().over(Window.partitionBy("win").orderBy(sign, "start_ts", "expiry", "duration", "type", "symbol"))
    return units.withColumn("nth", nth).where(F.col("nth") <= limit).withColumn("instruments", F.slice("instruments", 1, symbols))
