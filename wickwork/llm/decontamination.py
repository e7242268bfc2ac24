"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Words are lower-case runs of letters and digits. A seed hashes the words at the
places of a fixed mask and ignores those between. Texts and items overlap if
some stretch of WINDOW aligned words (the whole item, if it is shorter) agrees
in SHARE of its places, and the masks are such that no overlap is without a
seed: of any WINDOW aligned words of which two differ, one of the two masks of
MASKS lies on equal words only, wherever they are; an item of fewer words has
masks of its own length that divide its places among them, one mask more than
words may differ (a single mask on all words where none may). Seeds of the
texts are joined with those of the benchmark, and each hit is verified along
its diagonal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickwork.llm.common import cut, table

#: Places of a seed's words; both masks span SPAN words.
MASKS, SPAN = ((0, 1, 2, 3, 5, 8), (0, 3, 4, 6, 7, 8)), 9
WINDOW, SHARE = 13, 0.8
#: Rows of one text with hits are dealt to so many tasks.
SALTS = 16


def words_of(text: str) -> Column:
    """Lower-case words of a text column; empty for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def least_equal(n: int) -> int:
    """How many words of a stretch of n have to agree."""
    return math.ceil(n * SHARE - 1e-9)


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks of an item of n < WINDOW words: they share no place, and there is one more than words may differ."""
    k = n - least_equal(n) + 1
    return [tuple(range(m, n, k)) for m in range(k)]


def _seeded(hashed: DataFrame, key: str, masks, span: int, kind: int) -> DataFrame:
    """(key, place, seed) of each seed of the word hashes h: at each place that leaves room for `span` words, one a mask."""
    h = F.col("h")

    def at(i: Column) -> Column:
        return F.array(*[F.xxhash64(F.lit(100 * kind + m), *[h[i + k] for k in mask]) for m, mask in enumerate(masks)])

    seeds = F.flatten(F.transform(F.sequence(F.lit(0), F.size(h) - span), at))
    places = hashed.where(F.size(h) >= span).select(key, F.posexplode(seeds).alias("at", "seed"))
    return places.select(key, F.floor(F.col("at") / len(masks)).cast("int").alias("place"), "seed")


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, doc_start, n_item, n_match, identity: a row for each document and item that overlap.

    doc_start is the word of the document at which the item's first word would
    stand (negative if the overlap begins inside the item), n_item the item's
    words, n_match those that agree along the best diagonal, identity the share
    that agrees in its best stretch. Items of every length are looked for, one
    word included; of one to four words all have to agree. Texts and items that
    are null or without a word overlap with nothing. Repeated document rows
    give one row. Equal items are looked for once and reported for each id, a
    null id too; of several texts of one id the best overlap is reported. Extra
    columns are ignored.
    """
    text = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    listed = benchmark.select("item_id", F.xxhash64(F.col("text").cast("string")).alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")
    items = listed.groupBy("item").agg(F.first("text").alias("text")).select("item", words_of("text").alias("b")).where(F.size("b") > 0)
    hashes = lambda words: F.transform(words, lambda w: F.xxhash64(w)).alias("h")
    hashed = text.where("text is not null").select("key", hashes(words_of("text")))
    asked = items.select("item", hashes("b"))
    mine, theirs = _seeded(hashed, "key", MASKS, SPAN, 0), _seeded(asked.where(F.size("h") >= WINDOW), "item", MASKS, SPAN, 0)
    # The lengths of short items, WINDOW - 1 at most: only their masks are worked out.
    for (n,) in sorted(asked.where(F.size("h") < WINDOW).select(F.size("h")).distinct().collect()):
        mine = mine.unionByName(_seeded(hashed, "key", short_masks(n), n, n))
        theirs = theirs.unionByName(_seeded(asked.where(F.size("h") == n), "item", short_masks(n), n, n))
    theirs = theirs.select("item", "seed", F.col("place").alias("item_place"))
    # Equal texts share their hits; a pair has at most as many shifts as both have words. Either side is broadcast only if Spark finds it below the session's limit.
    hits = mine.join(theirs, "seed").groupBy("key", "item").agg(F.collect_set(F.col("place") - F.col("item_place")).alias("shifts"))
    hits = cut(hits, "hits")
    # Each text is verified once, however often it occurs.
    one = text.join(hits.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    both = one.select("key", words_of("text").alias("w")).join(hits, "key").join(items, "item").select("key", "item", "b", "w", F.explode("shifts").alias("shift"))
    n = F.size("b")
    same = F.transform("b", lambda x, i: F.when(F.get("w", F.col("shift") + i) == x, 1).otherwise(0))
    both = both.select("key", "item", "shift", n.alias("n_item"), same.alias("same"), F.least(n, F.lit(WINDOW)).alias("width"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.col("n_item") - F.col("width")), lambda i: total(F.slice("same", i + 1, F.col("width")))))
    both = both.select("key", "item", "shift", "n_item", total(F.col("same")).alias("n_match"), best.alias("best"), "width")
    real = both.where(F.col("best") >= F.ceil(F.col("width") * SHARE - 1e-9))
    found = F.struct("n_match", (-F.col("shift")).alias("back"), "n_item", (F.col("best") / F.col("width")).alias("identity"))
    top = real.groupBy("key", "item").agg(F.max(found).alias("x")).join(listed.select("item", "item_id").distinct(), "item")
    top = top.groupBy("key", "item_id").agg(F.max("x").alias("x"))
    top = cut(top.select("key", "item_id", (-F.col("x.back")).alias("doc_start"), "x.n_item", "x.n_match", "x.identity"), "overlaps")
    salted = top.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = text.select("doc_id", "key", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["key", "salt"])
    return named.select("doc_id", *top.columns[1:], "key").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose text overlaps with no benchmark item."""
    bad = find_overlaps(docs, benchmark).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
    # Written first: a small table is then broadcast, and the documents are not shuffled.
    bad = cut(bad, "bad")
    match = docs["doc_id"].eqNullSafe(bad["__id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["__key"])
    return docs.join(bad, match, "left_anti")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")
