"""Near-duplicate vectors by an exact metric range join over pivot cells.

Unit vectors with cosine >= c lie within r = sqrt(2 - 2c). Every distinct
vector belongs to the cell of its nearest pivot and is also sent to each other
cell j that it could reach: by the triangle inequality y in cell j within r of
x gives d(x, pj) <= d(x, pi) + 2r, and the plane halfway between the pivots
gives the closer bound d(x, pj)^2 - d(x, pi)^2 <= 2r d(pi, pj). Cells are then
joined on their own. A large cell is cut into blocks, so that no task holds
more than two blocks however many vectors a cell has.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickwork.llm.common import cut, table
from wickwork.llm.components import connected_components, labels

#: Rows of one cell that are compared with each other in one task.
BLOCK = 4096
MAX_PIVOTS = 1024
SLACK = 1e-6


def _cells(pivots: dict[int, tuple[int, np.ndarray]], reach: float):
    """Map batches (node, vec) to (node, vec, home, cell): one row per cell that the vector can reach.

    `pivots` has the first cell and the pivots of each length of vector; vectors
    of different lengths share no cell.
    """
    gaps = {d: np.sqrt(np.maximum(0, 2 - 2 * p @ p.T)) for d, (_, p) in pivots.items()}

    def run(batches):
        for whole in batches:
            lengths = pc.list_value_length(whole.column("vec"))
            for d in pc.unique(lengths).to_pylist():
                yield from place(whole.filter(pc.equal(lengths, d)), *pivots[d], gaps[d])

    def place(batch, first, pivots, gap):
        x = np.array(batch.column("vec").to_pylist(), np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        square = np.maximum(0, 2 - 2 * x @ pivots.T)
        home = square.argmin(1)
        near = square[np.arange(len(x)), home][:, None]
        meets = (np.sqrt(square) - np.sqrt(near) <= 2 * reach + SLACK) & (square - near <= 2 * reach * gap[home] + SLACK)
        meets[np.arange(len(x)), home] = True
        row, cell = np.nonzero(meets)
        yield pa.RecordBatch.from_arrays(
            [batch.column("node").take(pa.array(row)), batch.column("vec").take(pa.array(row)), batch.column("mult").take(pa.array(row)), pa.array((cell + first).astype("int32")), pa.array(home[row] == cell)],
            ["node", "vec", "mult", "cell", "home"],
        )

    return run


def _unit(vectors) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / np.abs(x).max(1, keepdims=True)


def _compare(cosine: float):
    """Links between the home rows and all rows of one pair of blocks: counts, and a spanning star of each linked set."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        out = pd.DataFrame({"node": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "low": pd.Series(dtype="int64")})
        if left.empty or right.empty:
            return out
        a, b = _unit(left["vec"]), _unit(right["vec"])
        cos = (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)[None]
        ids, others, mult = left["node"].to_numpy(), right["node"].to_numpy(), right["mult"].to_numpy()
        i, j = np.nonzero((cos >= cosine) & (ids[:, None] != others[None]))
        if not len(i):
            return out
        n = np.bincount(i, weights=mult[j], minlength=len(ids)).astype("int64")
        nodes, ends = np.unique(np.concatenate([ids[i], others[j]]), return_inverse=True)
        label = labels(len(nodes), ends[: len(i)], ends[len(i) :])
        count = dict(zip(ids.tolist(), n.tolist(), strict=True))
        return pd.DataFrame({"node": nodes, "n": [count.get(x, 0) for x in nodes.tolist()], "low": nodes[label]})

    return run


def range_links(vectors: DataFrame, cosine: float = 0.95, block: int = BLOCK) -> DataFrame:
    """(node, n, low) from distinct `vectors` (node, vec, mult).

    Summed over a node, n is the copies of other vectors within the range; the
    pairs (node, low) connect all that is linked. Vectors of one length are
    compared; a length takes a job for its pivots.
    """
    spark = vectors.sparkSession
    size = F.size("vec")
    totals = {r["d"]: r["n"] for r in vectors.groupBy(size.alias("d")).agg(F.count("*").alias("n")).collect()}
    pivots, cells = {}, 0
    for d, total in sorted(totals.items()):
        k = max(1, min(MAX_PIVOTS, math.ceil(total / block)))
        # A bounded sample that every run draws alike: the pivots.
        p = np.array([r["vec"] for r in vectors.where(size == d).select("vec", F.xxhash64(F.lit(17), "node").alias("h")).orderBy("h").limit(k).collect()], np.float64)
        p = p / np.abs(p).max(1, keepdims=True)
        pivots[d] = cells, p / np.linalg.norm(p, axis=1, keepdims=True)
        cells += k
    if not pivots:
        return spark.createDataFrame([], "node bigint, n bigint, low bigint")
    kind = vectors.schema["vec"].dataType.simpleString()
    schema = f"node bigint, vec {kind}, mult bigint, cell int, home boolean"
    placed = cut(vectors.select("node", "vec", "mult").mapInArrow(_cells(pivots, math.sqrt(2 - 2 * cosine)), schema), "cells")
    # One row a cell, MAX_PIVOTS a length at most.
    sizes = placed.groupBy("cell").agg(F.count("*").alias("all"), F.count_if("home").alias("own"))
    sizes = sizes.select("cell", F.ceil(F.col("all") / block).alias("gr"), F.ceil(F.col("own") / block).alias("gl"))
    rows = placed.join(F.broadcast(sizes), "cell").where("gl > 0")
    h, zero = F.xxhash64(F.lit(5), "node"), F.lit(0).cast("bigint")
    home = rows.where("home").select("cell", F.pmod(h, "gl").alias("bl"), F.explode(F.sequence(zero, F.col("gr") - 1)).alias("br"), F.lit(0).alias("side"), "node", "vec", "mult")
    probe = rows.select("cell", F.explode(F.sequence(zero, F.col("gl") - 1)).alias("bl"), F.pmod(h, "gr").alias("br"), F.lit(1).alias("side"), "node", "vec", "mult")
    return home.unionByName(probe).groupBy("cell", "bl", "br").applyInPandas(_compare(cosine), "node bigint, n bigint, low bigint")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of `vectors` (vec_id, embedding).

    Null vectors, zero vectors, and those with null or non-finite components
    link with nothing: n_links 0, component_id their own vec_id. Vectors are
    compared with those of their own length. Equal vectors are compared once and counted
    as often as they occur. Rows that repeat a vec_id with its vector count as
    one vector and each get the same row; if a vec_id comes with different
    vectors each of them is a vector of that id. A null vec_id counts among the
    links of others but never names a component that has an id; kept is false
    for it. Other columns are ignored; an empty table gives an empty result.
    """
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    v = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    good = F.coalesce(
        (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)
    )
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("vec"), good.alias("good"))
    key = F.xxhash64("vec", F.size("vec"))
    rows = rows.withColumn("node", F.when(F.col("good"), key))
    alike = rows.where("good").groupBy("node", "vec").agg(F.count_distinct(F.coalesce("vec_id", F.lit(-1 << 63))).alias("mult"), F.min("vec_id").alias("first"))
    alike = cut(alike, "vectors")
    found = cut(range_links(alike, cosine, block), "links")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("low").alias("b")))
    named = cut(alike.join(counts, "node", "left").join(roots, "node", "left").select("node", "first", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "rooted")
    lowest = cut(named.groupBy("root").agg(F.min("first").alias("component_id")), "lowest")
    named = cut(named.join(lowest, "root").select("node", "n_links", "component_id"), "named")
    out = rows.select("vec_id", "node").join(named, "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op9_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
