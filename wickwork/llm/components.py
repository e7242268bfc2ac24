"""Connected components by alternating large-star and small-star rounds.

Each round is two joins and two grouped minima over the edge table; no
neighbour list is ever gathered, and nothing but two numbers a round reaches
the driver. A hub may have as many edges as its component has nodes: minima
are aggregated before they are shuffled, and written before they are joined
back, so that both sides of the join are shuffled for it and adaptive
execution can split the hub's rows. Tables of a round are removed after it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.sources.scratch import fresh, remove, store


def labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest place reachable from each of `n` places over the links (u, v), inside one task."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b) -> (node, root): root is the smallest node reachable.

    Nodes without an edge to another node are not returned. Null ends and
    self-links are ignored; repeated edges do not matter.
    """
    spark = edges.sparkSession
    root = fresh(spark, "components")
    e = store(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{root}/edges0")
    mark = _mark(e)
    for k in range(1, max_rounds + 1):
        if not mark[0]:
            break
        work = f"{root}/round{k}"
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = store(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{work}/low")
        large = store(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{work}/large")
        low = store(large.groupBy("u").agg(F.min("v").alias("m")), f"{work}/lower")
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = store(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{root}/edges{k}")
        last, mark = mark, _mark(e)
        remove(spark, work)
        remove(spark, f"{root}/edges{k - 1}")
        if mark == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
