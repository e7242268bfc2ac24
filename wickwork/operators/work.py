"""What is still to be done: incremental work lists and resumption."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR = ["spot", "expiry"]


def work_list(expiries: DataFrame, done_candles: DataFrame, done_signals: DataFrame, phase: str, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(to do, lacking): settled pairs (column settled) that `phase` ('candles' or 'signals') has not done, newest first.

    Signals need stored candles; pairs without them are reported as lacking.
    `force` does again what is done.
    """
    pairs = expiries.where("settled").select(*PAIR)
    have = done_candles.select(*PAIR).distinct()
    if phase == "candles":
        todo = pairs if force else pairs.join(have, PAIR, "left_anti")
        lacking = pairs.limit(0)
    else:
        ready = pairs.join(have, PAIR, "left_semi")
        todo = ready if force else ready.join(done_signals.select(*PAIR).distinct(), PAIR, "left_anti")
        lacking = pairs.join(have, PAIR, "left_anti")
    return todo.orderBy(F.desc("expiry"), "spot"), lacking.orderBy(F.desc("expiry"), "spot")


def pending_symbols(instruments: DataFrame, stored: DataFrame) -> DataFrame:
    """Instruments of which no candle is stored."""
    return instruments.join(stored.select(*PAIR, "symbol").distinct(), [*PAIR, "symbol"], "left_anti")


def completeness(results: DataFrame) -> DataFrame:
    """Per (spot, expiry) whether every symbol went well (column ok)."""
    return results.groupBy(*PAIR).agg(F.bool_and("ok").alias("complete"), F.count("*").alias("symbols"), F.count_if(~F.col("ok")).alias("failed"))
