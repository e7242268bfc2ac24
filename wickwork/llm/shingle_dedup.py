"""Near copies by the Jaccard similarity of their word shingles: SimHash and MinHash bands propose, exact sets decide.

A document is the set of its five-word shingles, the nth occurrence of one being
an element of its own: else a passage of few distinct shingles, however long,
would count for nothing and its document pass for a copy. Two documents whose
sets have Jaccard similarity s agree in one band of ROWS minima with
probability s^ROWS, so of pairs at SHARE itself all but (1 - SHARE^ROWS)^BANDS,
7 in 100,000, meet in some bucket, and more of closer ones. Every link is
checked on the whole sets.

SimHash proposes as in simhash_dedup, over the same shingles: fingerprints
within two bits are found by its covering masks, none of them missed, and the
nodes of a component of such fingerprints share a bucket.

Documents of equal sets are one node. A bucket's members are first compared
with one of them, its hub: the one that a hash puts first, so that buckets of
one group mostly share it. All that meets a hub in some bucket is one group;
where the hub leaves its members in different components they are compared with
each other in blocks of bounded size, inside tasks, which give a spanning star
of what is linked. No pairs are emitted, and groups of equal members are
compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm.common import cut, filter_bits, may_hold, text_slices
from wickwork.llm.components import connected_components, labels
from wickwork.llm.simhash_dedup import fingerprint_of, links, shingle_hashes, signed, text_key

SHINGLE, SHARE, BANDS, ROWS, SEED = 5, 0.8, 24, 5, 42
#: Odd multipliers, each a permutation of the 64-bit shingle hashes.
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles whose permuted hashes are held at once; members and shingles of a block; shingles of so many members are counted by matrices.
CHUNK, BLOCK, BLOCK_SHINGLES, COMMON = 4096, 2048, 1 << 20, 32


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Distinct hashes of a UTF-8 text's shingles and their occurrences, equal for equal bags; of a shorter text the one of all its words."""
    return _numbered(shingle_hashes(text, SHINGLE))


def _numbered(hashes: np.ndarray | list[int]) -> np.ndarray:
    h = np.sort(np.array(hashes, np.uint64))
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    if again.any():
        places = np.arange(len(h))
        nth = (places - np.maximum.accumulate(np.where(again, 0, places)))[again].astype(np.uint64)
        h[again] = _mixed(h[again] + nth * np.uint64(0x9E3779B97F4A7C15))
    return h


def bands(shingles: np.ndarray) -> list[int]:
    """A signed key for each band; none for the empty set."""
    if not len(shingles):
        return []
    low = np.min([(FACTORS * shingles[i : i + CHUNK]).min(axis=1) for i in range(0, len(shingles), CHUNK)], axis=0)
    keys = [xxhash.xxh64_intdigest(low[t * ROWS : (t + 1) * ROWS].tobytes(), t) for t in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _node(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def _signed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in text_slices(batch.column(2)):
            # Lists of one text's hashes at a time; arrays are an eighth of them.
            hashes = [np.array(shingle_hashes(t, SHINGLE), np.uint64) for t in texts]
            sets = [_numbered(h) for h in hashes]
            part = batch.slice(start, len(texts))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([signed(fingerprint_of(h)) for h in hashes], pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))],
                ["doc_id", "key", "node", "size", "fp", "bands"],
            )


def _open_bands(bits):
    """(node, size, bucket) of those buckets of each node that the filter does not deny."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            keys = column.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
            use = may_hold(bits.value, keys)
            at = pa.array(row[use])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(keys[use])], ["node", "size", "bucket"])

    return run


def _sets(bits):
    """(node, shingles) of the texts whose key the filter does not deny."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            use = np.flatnonzero(may_hold(bits.value, batch.column(0).to_numpy()))
            for _, texts in text_slices(batch.column(1).take(pa.array(use))):
                sets = [shingle_set(t) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"])

    return run


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose sets have similarity SHARE or more."""
    left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    compared = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb") - both).alias("any"))
    return compared.where(F.col("both") >= F.col("any") * SHARE - 1e-9).select("a", "b")


def _pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs of nodes (a < b), without those whose sizes alone rule SHARE out."""
    fits = F.least(f"{a}.size", f"{b}.size") >= F.greatest(f"{a}.size", f"{b}.size") * SHARE - 1e-9
    return rows.where(fits & (F.col(f"{a}.node") != F.col(f"{b}.node"))).select(F.least(f"{a}.node", f"{b}.node").alias("a"), F.greatest(f"{a}.node", f"{b}.node").alias("b")).distinct()


def shared_counts(left: list, right: list) -> np.ndarray:
    """How many elements each set of `left` has in common with each of `right`: common elements by matrix products, rare ones one by one."""
    n, m = len(left), len(right)
    every, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    cut_ = sum(map(len, left))
    owner = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    column = [at[:cut_], at[cut_:]]
    times = [np.bincount(c, minlength=len(every)) for c in column]
    total = np.zeros((n, m), np.float32)
    both = (times[0] > 0) & (times[1] > 0)
    often = np.flatnonzero(both & (times[0] + times[1] > COMMON))
    for i in range(0, len(often), CHUNK):
        place = np.full(len(every), -1)
        place[often[i : i + CHUNK]] = np.arange(len(often[i : i + CHUNK]))
        parts = []
        for o, c, size in zip(owner, column, (n, m), strict=True):
            use = place[c] >= 0
            part = np.zeros((size, len(often[i : i + CHUNK])), np.float32)
            part[o[use], place[c[use]]] = 1
            parts.append(part)
        total += parts[0] @ parts[1].T
    rare = both & (times[0] + times[1] <= COMMON)
    order = np.argsort(column[1], kind="stable")
    first = np.concatenate([[0], np.cumsum(times[1])])[:-1]
    use = np.flatnonzero(rare[column[0]])
    again = times[1][column[0][use]]
    begin = np.repeat(first[column[0][use]] - np.cumsum(again) + again, again)
    pairs = np.repeat(owner[0][use], again) * m + owner[1][order][begin + np.arange(len(begin))]
    return total + np.bincount(pairs, minlength=n * m).reshape(n, m)


def _linked(pdf: pd.DataFrame) -> pd.DataFrame:
    """A spanning star (a, b) of the links between the members of two blocks (or within one) of one hub."""
    i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
    left, right = pdf[pdf["own"] == i], pdf[pdf["own"] == j]
    out = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
    if left.empty or right.empty:
        return out
    both = shared_counts(list(left["shingles"]), list(right["shingles"]))
    sizes = [x["size"].to_numpy() for x in (left, right)]
    near = both >= (sizes[0][:, None] + sizes[1][None] - both) * SHARE - 1e-9
    u, v = np.nonzero(near & (left["root"].to_numpy()[:, None] != right["root"].to_numpy()[None]))
    if not len(u):
        return out
    nodes, ends = np.unique(np.concatenate([left["node"].to_numpy()[u], right["node"].to_numpy()[v]]), return_inverse=True)
    low = nodes[labels(len(nodes), ends[: len(u)], ends[len(u) :])]
    return pd.DataFrame({"a": nodes, "b": low})[nodes != low]


def _block_links(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) that connect what is linked among the members `rest` (hub, node, size, root) of each hub, where these are of several components."""
    sign = F.xxhash64(F.lit(SEED + 1), "node")
    held = rest.groupBy("hub").agg(F.min("root").alias("l"), F.max("root").alias("m"), F.count("*").alias("n"), F.sum("size").alias("s"), F.bit_xor(sign).alias("x"), F.min(sign).alias("y"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    open_ = held.where("l <> m").groupBy("n", "s", "x", "y").agg(F.min("hub").alias("hub")).select("hub", blocks.alias("g"))
    own = F.pmod(F.xxhash64(F.lit(SEED), "node"), F.col("g")).cast("int")
    dealt = rest.join(cut(open_, "open"), "hub").select("hub", "node", "size", "root", "g", own.alias("own"))
    # Block k meets each block once: as the first of the pair (k, j) or the second of (i, k).
    pair = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda k: F.struct(F.least(k, "own").alias("i"), F.greatest(k, "own").alias("j")))
    cells = dealt.join(sets, "node").select("hub", "node", "size", "root", "own", "shingles", F.explode(pair).alias("p"))
    cells = cells.select("hub", "p.i", "p.j", "node", "size", "root", "own", "shingles")
    return cells.groupBy("hub", "i", "j").applyInPandas(_linked, "a bigint, b bigint")


def _alike(nodes: DataFrame) -> DataFrame:
    """(node, size, bucket) of nodes whose fingerprints lie in one component of links of two bits, where it has several nodes."""
    fps = nodes.select("node", "size", "fp")
    roots = connected_components(links(fps.select("fp").distinct())).select(F.col("node").alias("fp"), "root")
    named = cut(fps.join(roots, "fp", "left").select("node", "size", F.xxhash64(F.lit(BANDS), F.coalesce("root", "fp")).alias("bucket")), "alike")
    several = named.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    return named.join(several, "bucket").select("node", "size", "bucket")


def shingle_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, key, root) of each row of `docs`: key is that of its text, root names its group of near copies.

    Groups are the components of the links of similarity SHARE or more. Texts
    that are null, empty or blank are one group.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key("text").alias("key"), F.col("text").cast("string").alias("text"))
    rows = cut(rows.mapInArrow(_signed_rows, "doc_id bigint, key bigint, node bigint, size bigint, fp bigint, bands array<bigint>"), "signatures")
    # Texts of equal sets are one node, for which one of them stands.
    one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("p")
    nodes = cut(rows.groupBy("node").agg(F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), one), "nodes")
    # Most buckets hold one node: a filter of the others spares them the exact join.
    counts = nodes.select(F.explode("bands").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    sc = docs.sparkSession.sparkContext
    open_ = sc.broadcast(filter_bits(cut(counts.where("n > 1").select("bucket"), "open")))
    keyed = cut(nodes.select("node", "size", "bands").mapInArrow(_open_bands(open_), "node bigint, size bigint, bucket bigint").unionByName(_alike(nodes)), "keyed").select(F.struct("node", "size").alias("x"), "bucket")
    turned = F.struct(F.xxhash64(F.lit(SEED), "x.node").alias("h"), "x")
    hubs = keyed.groupBy("bucket").agg(F.min(turned).alias("h0"), F.max(turned).alias("h1")).where("h0.x.node <> h1.x.node")
    hubs = cut(hubs.select("bucket", F.col("h0.x").alias("y")), "buckets")
    members = cut(keyed.join(hubs, "bucket").where("x.node <> y.node").select("x", "y").distinct(), "members")
    # One text of each node that shares a bucket; the texts are read where they lie.
    shares = members.select("x.node").unionByName(members.select("y.node")).distinct()
    picked = cut(nodes.select("node", "p").join(shares, "node", "left_semi").select(F.xxhash64("p.doc_id", "p.key").alias("row")), "picked")
    bits = sc.broadcast(filter_bits(picked))
    text = docs.select(F.xxhash64(F.col("doc_id").cast("bigint"), text_key("text")), F.col("text").cast("string"))
    sets = cut(text.mapInArrow(_sets(bits), "node bigint, shingles array<bigint>").join(shares, "node", "left_semi").dropDuplicates(["node"]), "sets")

    found = cut(_near(_pairs(members, "x", "y"), sets), "near")
    label = connected_components(found).select(F.col("node").alias("__n"), "root")
    named = members.join(label, F.col("x.node") == F.col("__n"), "left").select(F.col("y.node").alias("hub"), "x.node", "x.size", F.coalesce("root", "x.node").alias("root"))
    every = cut(found.unionByName(_block_links(cut(named, "labels"), sets)), "links")
    roots = cut(connected_components(every).select("node", "root"), "roots")
    return rows.select("doc_id", "key", "node").join(roots, "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("root"))
