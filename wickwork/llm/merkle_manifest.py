"""A Merkle manifest of the documents, written as a postorder log.

Leaves are hashed by Spark and numbered inside their tree by a range sort. An
aligned builder takes FAN leaves of a tree, hashes them up and appends each node
to its part of the log when it is complete: a leaf, then every parent that this
leaf completes. The tops of the builders are the leaves of the next builders, so
there are log(leaves) / log(FAN) rounds, and no task ever holds more than FAN
nodes of a tree. The tops of all trees are the leaves of one more tree.

In postorder a node's place needs no index. Before leaf a there are
2 a - popcount(a) nodes, and the subtree over m leaves on level l has
m + ceil(m / 2) + ... + ceil(m / 2^l) nodes, of which the node itself is the
last. Proofs are read from the parts of the log at these places, from the top
builders down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickwork.llm.common import cut, table

#: Leaves of a builder, 2^HEIGHT of them.
HEIGHT = 7
FAN = 1 << HEIGHT
#: The tree of the other trees' tops; trees of languages begin with 0 (null) or 1.
TOP = "top"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: bytes) -> bytes:
    """sha256 of digests taken as hex text."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    return max(0, n - 1).bit_length()


def size_at(level: int, leaves: int) -> int:
    """Nodes of a subtree of that level over so many leaves."""
    return sum((leaves + (1 << k) - 1) >> k for k in range(level + 1))


def place(level: int, index: int, leaves: int) -> int:
    """Postorder place of a node in the log of a tree of so many leaves."""
    first = index << level
    return 2 * first - first.bit_count() + size_at(level, min(1 << level, leaves - first)) - 1


def append_log(leaves: list[bytes], levels: int) -> list[bytes]:
    """The nodes over these leaves up to so many levels, in the order in which they are complete."""
    log, open_ = [], []
    for i, leaf in enumerate(leaves):
        node, level = leaf, 0
        log.append(node)
        while level < levels and (i >> level & 1 or i == len(leaves) - 1):
            node = digest(open_.pop()[1], node) if open_ and open_[-1][0] == level else digest(node)
            log.append(node)
            level += 1
        open_.append((level, node))
    return log


def siblings(log: list[bytes], index: int, leaves: int, levels: int) -> list[bytes]:
    """The other nodes of the runs on the way from a leaf up, as the log has them."""
    out = []
    for level in range(levels):
        other = (index >> level) ^ 1
        if other << level < leaves:
            out.append(log[place(level, other, leaves)])
    return out


def fold(node: bytes, index: int, leaves: int, path: Iterator[bytes]) -> bytes:
    """The top of a tree from one of its leaves and the siblings on its way."""
    for level in range(height(leaves)):
        at = index >> level
        if (at ^ 1) << level >= leaves:
            node = digest(node)
        else:
            node = digest(next(path), node) if at & 1 else digest(node, next(path))
    return node


def leaf_hash(n_chars: Column | None = None) -> Column:
    """The leaf of a document, as hex text; n_chars in place of its own where given."""

    def part(name: str) -> Column:
        value = (n_chars if name == "n_chars" and n_chars is not None else F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(part, FIELDS)), 256)


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(`rows` with `index` and `leaves`, (tree, leaves)): rows of each tree in this order.

    Rows are sorted by range, counted from their task's first one on and moved
    by what earlier tasks hold; equal rows may lie in several tasks.
    """
    kind = rows.schema
    names = rows.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, n = None, 0
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                n = n + 1 if t == tree else 0
                tree = t
                out.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*names, "index"])

    salt = F.monotonically_increasing_id().alias("__salt")
    many = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.select("*", salt).repartitionByRange(many, "tree", *order, "__salt").sortWithinPartitions("tree", *order).drop("__salt")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind)
    held = cut(ordered.mapInArrow(count, f"{kind}, index bigint").withColumn("__task", F.spark_partition_id()), "numbered")
    counts = held.groupBy("tree", "__task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("tree").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    whole = F.sum("n").over(Window.partitionBy("tree"))
    offsets = cut(counts.select("tree", "__task", F.coalesce(before, F.lit(0)).alias("__before"), whole.alias("leaves")), "offsets")
    moved = held.join(offsets, ["tree", "__task"]).withColumn("index", F.col("index") + F.col("__before")).drop("__task", "__before")
    return moved, offsets.groupBy("tree").agg(F.first("leaves").alias("leaves"))


LOG = "tree string, block bigint, leaves bigint, log array<binary>"


def _block(extra: list[pa.Field]):
    """One builder: its part of the log, and the rows that it was given."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("index")
        leaves = rows["leaves"][0].as_py()
        log = append_log(rows["node"].to_pylist(), min(HEIGHT, height(leaves)))
        columns = [pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int64()), pa.array([leaves], pa.int64()), pa.array([log], pa.list_(pa.binary()))]
        own = [pa.array([rows[f.name].to_pylist()], pa.list_(f.type)) for f in extra]
        return pa.table([*columns, *own], ["tree", "block", "leaves", "log", *[f.name for f in extra]])

    return run


def build(nodes: DataFrame, keep: dict[str, str] | None = None) -> list[DataFrame]:
    """The log of all trees of `nodes` (tree, index, leaves, node), one table a round, from the leaves up.

    Each row is the part of one builder. `keep` names further columns (and
    their SQL types) of the leaves, which the first round carries as arrays.
    """
    keep, rounds = keep or {}, []
    types = {"bigint": pa.int64(), "binary": pa.binary()}
    while True:
        grouped = nodes.withColumn("block", F.shiftright("index", HEIGHT)).groupBy("tree", "block")
        own = keep if not rounds else {}
        schema = LOG + "".join(f", {c} array<{k}>" for c, k in own.items())
        rounds.append(cut(grouped.applyInArrow(_block([pa.field(c, types[k]) for c, k in own.items()]), schema), "log"))
        above = F.ceil(F.col("leaves") / FAN).cast("bigint")
        nodes = rounds[-1].where(F.col("leaves") > FAN).select("tree", F.col("block").alias("index"), above.alias("leaves"), F.element_at("log", -1).alias("node"))
        if nodes.isEmpty():
            return rounds


def tops(rounds: list[DataFrame]) -> DataFrame:
    """(tree, node): the top of each tree."""
    parts = [r.where(F.col("leaves") <= FAN).select("tree", F.element_at("log", -1).alias("node")) for r in rounds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths (tree, index, path) of the leaves of builders, from (tree, block, leaves, log, path)."""
    for batch in batches:
        tree, index, path = [], [], []
        for r in batch.to_pylist():
            first = r["block"] * FAN
            held = min(FAN, r["leaves"] - first)
            for i in range(held):
                tree.append(r["tree"])
                index.append(first + i)
                path.append(siblings(r["log"], i, held, min(HEIGHT, height(r["leaves"]))) + (r["path"] or []))
        yield pa.RecordBatch.from_arrays([pa.array(tree, pa.string()), pa.array(index, pa.int64()), pa.array(path, pa.list_(pa.binary()))], ["tree", "index", "path"])


def paths(rounds: list[DataFrame]) -> DataFrame:
    """The first round's builders with `path`: the siblings from their tops to the top of the tree."""
    above = None
    for k in range(len(rounds) - 1, -1, -1):
        r = rounds[k]
        own = r.withColumn("path", F.lit(None).cast("array<binary>")) if above is None else r.join(above, ["tree", "block"], "left")
        if k:
            found = own.select("tree", "block", "leaves", "log", "path").mapInArrow(_below, "tree string, index bigint, path array<binary>")
            above = cut(found.withColumnRenamed("index", "block"), "paths")
    return own


def postorder_log(rounds: list[DataFrame], sizes: DataFrame) -> DataFrame:
    """(tree, position, node): the whole append log of each tree, from its builders' parts and its size (tree, leaves)."""

    def listed(done: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tree, position, node = [], [], []
                for r in batch.to_pylist():
                    held = min(FAN, r["leaves"] - r["block"] * FAN)
                    # The leaves of a later round are the tops of the one before.
                    for level in range(1 if done else 0, min(HEIGHT, height(r["leaves"])) + 1):
                        for i in range((held + (1 << level) - 1) >> level):
                            tree.append(r["tree"])
                            position.append(place(done + level, (r["block"] << HEIGHT - level) + i, r["size"]))
                            node.append(r["log"][place(level, i, held)].hex())
                yield pa.RecordBatch.from_arrays([pa.array(tree, pa.string()), pa.array(position, pa.int64()), pa.array(node, pa.string())], ["tree", "position", "node"])

        return run

    named, out = sizes.select("tree", F.col("leaves").alias("size")), None
    for k, r in enumerate(rounds):
        part = r.select("tree", "block", "leaves", "log").join(named, "tree").mapInArrow(listed(k * HEIGHT), "tree string, position bigint, node string")
        out = part if out is None else out.unionByName(part)
    return out


RESULT = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proved(root: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RESULT.split(", ")]
        for batch in batches:
            for n in range(batch.num_rows):
                (r,) = batch.slice(n, 1).to_pylist()
                first, leaves, rows = r["block"] * FAN, r["leaves"], []
                held = len(r["ids"])
                upper = (r["path"] or []) + (r["over"] or [])
                for i, (doc_id, bad) in enumerate(zip(r["ids"], r["bad"], strict=True)):
                    leaf = r["log"][place(0, i, held)]
                    path = siblings(r["log"], i, held, min(HEIGHT, height(leaves))) + upper
                    rest = iter(path)
                    made = fold(fold(bad or leaf, first + i, leaves, rest), r["nth"], r["trees"], rest)
                    rows.append((doc_id, leaf.hex(), r["subroot"].hex(), root.hex(), digest(*path).hex(), made.hex(), made == root))
                kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def leaves_of(docs: DataFrame, bad: Column | None = None) -> DataFrame:
    """(tree, ids, node, bad): the leaf of each document."""
    tree = F.when(F.col("lang").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("lang")))
    bad = F.lit(None).cast("binary") if bad is None else bad
    return cut(docs.select(tree.alias("tree"), F.col("doc_id").cast("bigint").alias("ids"), F.unhex(leaf_hash()).alias("node"), bad.alias("bad")), "leaves")


def language_logs(docs: DataFrame) -> DataFrame:
    """lang, position, node: the append log of each language's tree, one row per node."""
    rows, sizes = numbered(leaves_of(docs).select("tree", "ids", "node"), ["ids", "node"])
    log = postorder_log(build(rows), sizes)
    return log.select(F.when(F.col("tree") != "0", F.substring("tree", 2, 1 << 30)).alias("lang"), "position", "node")


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """The columns of RESULT, one row per row of `docs` (FIELDS; other columns are ignored).

    Each language is a tree, null one of its own; leaves ascend by doc_id, null
    first, and of equal ids by leaf. subroot is the top of the language's tree,
    root that over all subroots, proof_sha256 a digest of the siblings on the
    way. Where `tampered` is true folded_root is worked out from a leaf whose
    n_chars is one more (null stays null), else from the leaf itself. Repeated
    rows have leaves and proofs of their own. An empty table gives no rows.
    """
    spark = docs.sparkSession
    tampered = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    bad = F.when(tampered & F.col("n_chars").isNotNull(), F.unhex(leaf_hash(F.col("n_chars").cast("bigint") + 1)))
    rows, _ = numbered(leaves_of(docs, bad), ["ids", "node"])
    rounds = build(rows, {"ids": "bigint", "bad": "binary"})
    subroots, _ = numbered(tops(rounds).select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "node"), ["name"])
    subroots = cut(subroots, "subroots")
    over = build(subroots.select("tree", "index", "leaves", "node"))
    root = tops(over).first()
    if root is None:
        return spark.createDataFrame([], RESULT)
    way = paths(over).select("tree", "block", "leaves", "log", "path").mapInArrow(_below, "tree string, index bigint, path array<binary>")
    way = subroots.join(way.select("index", F.col("path").alias("over")), "index").select(F.col("name").alias("tree"), F.col("node").alias("subroot"), F.col("index").alias("nth"), F.col("leaves").alias("trees"), "over")
    proved = paths(rounds).join(cut(way, "ways"), "tree")
    return proved.mapInArrow(_proved(bytes(root["node"])), RESULT)


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
