"""SimHash near-duplicates found by covering locality-sensitive hashing.

Each of the 64 fingerprint bits is given one of the seven non-zero vectors of
F2^3. A table keeps the bits whose vector has odd product with the table's own
vector: seven masks of 36 or 37 bits. Two differing bits span at most a plane,
so some table's vector is orthogonal to both and its mask drops exactly such
bits: every pair within two bits shares a key in at least one table.

Inside a table's bucket no pairs are made. Members differ only in the dropped
bits, and two of them lie within two bits exactly if a point within one bit of
both exists. Each member of a shared bucket is therefore sent to itself and to
its one-bit neighbours among the dropped bits; a meeting point has at most 29
different members a table, whatever the size of the bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickwork.llm.common import cut, filter_bits, may_hold, table
from wickwork.llm.components import connected_components

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42


def masks() -> list[int]:
    """The covering masks for RADIUS: 2^(RADIUS+1) - 1 of them."""
    vectors = range(1, 1 << (RADIUS + 1))
    return [sum(1 << i for i in range(BITS) if ((i % len(vectors) + 1) & v).bit_count() % 2) for v in vectors]


def text_key(text: str) -> Column:
    """A key of a text column; null has one too."""
    return F.xxhash64(F.col(text).cast("string"))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: bytes | None, size: int = SHINGLE) -> list[int]:
    """Hashes of a UTF-8 text's shingles of `size` words; of a shorter text that of all its words, none where it has no word."""
    words = (text or b"").lower().split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(joined, SEED)]
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - size] + 1).tolist()]
    ends = [*gaps[size - 1 :].tolist(), len(joined)]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)]


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """Unsigned SimHash of a UTF-8 text; 0 where it has no word."""
    return fingerprint_of(shingle_hashes(text, size))


def fingerprint_of(hashes: list[int]) -> int:
    """Unsigned SimHash of 64-bit hashes; 0 where there is none."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *batch.columns[2:], pa.array([signed(fingerprint(t)) for t in texts], pa.int64())], ["doc_id", *batch.schema.names[2:], "fp"]
        )


def fingerprints(docs: DataFrame, *longs: str) -> DataFrame:
    """(doc_id, longs, fp): one row per document, fp the fingerprint as a signed long, `longs` columns that stay."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), *longs).mapInArrow(
        _fingerprints, ", ".join(f"{c} bigint" for c in ("doc_id", *longs, "fp"))
    )


def links(fps: DataFrame) -> DataFrame:
    """(a, b) links among distinct fingerprints (column fp) that keep every component whole.

    Each link is real (at most RADIUS differing bits); of the pairs that meet
    in one point only those with the smallest member are given.
    """
    kept = masks()
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(signed(m)).alias("mask")) for t, m in enumerate(kept)])
    dropped = F.array(*[F.array(F.lit(0).cast("bigint"), *[F.lit(signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in kept])
    keyed = fps.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", F.col("fp").bitwiseAND(F.col("x.mask")).alias("key"))
    # Written first, so that a bucket with very many members is split in the join.
    shared = cut(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "buckets")
    members = keyed.join(shared, ["t", "key"]).select("t", "fp")
    points = members.select("fp", F.explode(F.transform(dropped[F.col("t")], lambda bit: F.col("fp").bitwiseXOR(bit))).alias("point"))
    hub = F.min("fp").over(Window.partitionBy("point"))
    return points.distinct().select(hub.alias("a"), F.col("fp").alias("b")).where("a <> b").distinct()


def _roots(rows: DataFrame) -> DataFrame:
    """(fp, first, root) of each fingerprint of rows (doc_id, fp): its smallest doc_id, and the name of its component."""
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(links(nodes.select("fp"))).select(F.col("node").alias("fp"), "root")
    return cut(nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex), component_id, one row per row of `docs`.

    component_id is the smallest doc_id reachable over links of at most two
    bits. Texts that are null, empty or blank have fingerprint zero and link
    like any other. Equal fingerprints are one node, so copies are never
    paired up. Rows with a null doc_id take part; component_id is null only if
    every row of a component has a null doc_id. Repeated rows each get a row.
    Other columns are ignored. An empty table gives an empty result.
    """
    rows = cut(fingerprints(docs), "fingerprints")
    rooted = _roots(rows)
    lowest = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "lowest")
    named = cut(rooted.join(lowest, "root").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, key, root) of each row of `docs`: key is that of its text, root names its component."""
    rows = cut(fingerprints(docs.select("doc_id", "text", text_key("text").alias("key")), "key"), "fingerprints")
    return rows.join(_roots(rows).select("fp", "root"), "fp").select("doc_id", "key", "root")


def keep_one(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame] = simhash_groups) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id.

    Of several rows with that id in the group the first by text stays. Rows
    with a null doc_id stay only if their whole group has none, and then one of
    them, the first by text. Rows are told apart by id and text, so rows that
    share an id but lie in different groups do not touch each other. `grouped`
    gives (doc_id, key, root) of the rows. All columns of `docs` are returned
    unchanged.
    """
    kinds = grouped(docs).groupBy("root", F.col("doc_id").alias("id"), "key").agg(F.count("*").alias("n"))
    kinds = cut(kinds, "kinds")
    first = cut(kinds.groupBy("root").agg(F.min("id").alias("lowest"), F.sum("n").alias("all")).where("all > 1").drop("all"), "first")
    # Only rows of groups of several; one kind of row may still occur often.
    shared = cut(kinds.join(first, "root").withColumn("best", F.col("id").eqNullSafe(F.col("lowest"))), "shared")
    tied = shared.where("best").groupBy("root").agg(F.sum("n").alias("rows")).where("rows > 1").select("root")
    tied = cut(shared.where("best").join(tied, "root").select("root", "id", "key"), "tied")
    gone = cut(shared.where("not best").select("id", "key").unionByName(tied.select("id", "key")), "gone")
    # Rows that are in no list, as the filter tells, need no join and are not shuffled.
    bits = docs.sparkSession.sparkContext.broadcast(filter_bits(gone.select(F.xxhash64("id", "key").alias("listed"))))
    listed = F.pandas_udf(lambda keys: pd.Series(may_hold(bits.value, keys.to_numpy())), "boolean")
    # The row stands in a column of its own, so that none of its names can clash.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("__id"), text_key("text").alias("__key"))
    packed = packed.withColumn("__listed", listed(F.xxhash64("__id", "__key")))
    match = F.col("__id").eqNullSafe(F.col("id")) & (F.col("__key") == F.col("key"))
    untouched = packed.where("not __listed").select("row")
    once = packed.where("__listed").join(gone, match, "left_anti").select("row")
    order = Window.partitionBy("root").orderBy(F.col("row.text").asc_nulls_last())
    many = packed.where("__listed").join(tied, match).withColumn("nth", F.row_number().over(order)).where("nth = 1").select("row")
    return untouched.unionByName(once).unionByName(many).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op7_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
