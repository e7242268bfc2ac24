"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets are filled by weight up to a repeat limit. The total is cut into equal
blocks of words; sources, and then each source's shards, get whole numbers of
blocks by the highest quotients votes / (2 seats + 1). Inside a shard the
documents stand in seeded order, and the quota is a run of blocks that starts
at a seeded block and goes round the shard's stream as often as needed. What a
document gives is then plain arithmetic on its place in the stream. Equal rows
are counted before anything is ordered.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickwork.llm.common import GAPS, cut, table, word_count

SHARE, REPEAT, WEIGHTS = 1.5, 2.0, (3.0, 1.0, 2.0)
#: Words a shard holds; there are at most MAX_SHARDS, so the driver's tables stay small.
SHARD_WORDS, MAX_SHARDS = 1 << 16, 20_000
#: Words of a block; it is smaller where that is more than a PART of the smallest target, so that every source gets its share.
BLOCK_WORDS, PART, SEED = 64, 16, 20240607


def fill_targets(sizes: list[float], weights: list[float], total: float, repeat: float = REPEAT) -> list[float]:
    """Shares of `total` by weight; a share stops at repeat * size, the excess is shared anew by weight."""
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), total
    while open_:
        whole = sum(weights[i] for i in open_)
        full = [i for i in sorted(open_) if left * weights[i] / whole >= repeat * sizes[i]]
        if not full:
            for i in open_:
                target[i] = left * weights[i] / whole
            break
        for i in full:
            target[i] = repeat * sizes[i]
        open_ -= set(full)
        left = max(0.0, total - sum(target))
    return target


def sainte_lague(votes, seats: int, most=None) -> np.ndarray:
    """Seats by the highest quotients votes / (2 s + 1); ties go to the earlier entry.

    `most` limits the seats of each entry. The divisor is found by bisection
    and the last few seats are dealt one by one, which gives the same seats as
    dealing all of them by quotient.
    """
    votes = np.asarray(votes, float)
    most = np.full(len(votes), np.iinfo(np.int64).max // 2) if most is None else np.asarray(most, np.int64)
    most = np.where(votes > 0, most, 0)
    seats = int(min(seats, most.sum()))
    got = np.zeros(len(votes), np.int64)
    if seats <= 0:
        return got
    at = lambda x: np.minimum(np.floor(votes / x / 2 + 0.5).astype(np.int64), most)  # noqa: E731  entries whose quotient is at least x
    low, high = votes[votes > 0].min() / (2.0 * seats + 3), 2 * votes.max()
    while at(low).sum() < seats:
        low /= 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if at(mid).sum() >= seats else (low, mid)
    got = at(high)
    while got.sum() < seats:
        quotient = np.where(got < most, votes / (2 * got + 1), -1)
        got[int(quotient.argmax())] += 1
    return got


def _seeded(seed: int, *columns: str) -> Column:
    """A number below 2^32 from a seed and columns; nulls are skipped."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])), 1, 8), 16, 10).cast("bigint")


def sizes_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count("text").alias("size"))


def plan_mix(sized: DataFrame, weights=WEIGHTS, share=SHARE, repeat=REPEAT, block=BLOCK_WORDS, seed=SEED) -> DataFrame:
    """What is taken of each kind of row of `sized` (doc_id, source, size, and `row` where rows have a key of their own).

    Rows that are equal in these columns are one kind, so that no number of
    them fills a shard. The result has those columns, source_size, target, n
    (rows of the kind) and passes, start, shard_size, lo and rest: the n rows
    stand one after the other in the stream of their shard, the first from word
    `start` on, each is taken `passes` times whole, and what lies in the run
    of `rest` words from word `lo` on, round the shard, once more.
    """
    spark = sized.sparkSession
    kinds = sized.groupBy(*sized.columns).agg(F.count("*").alias("n"))
    kinds = cut(kinds, "kinds")
    # One row per source.
    rows = kinds.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("n")).collect()
    rows.sort(key=lambda r: (r["source"] is None, [ord(c) for c in r["source"] or ""]))
    sizes = [int(r["n"] or 0) for r in rows]
    total = sum(sizes)
    targets = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], share * total, repeat)
    block = min(block, max(1, int(min((t for t in targets if t > 0), default=0) / PART)))
    shard_words = max(SHARD_WORDS, total / MAX_SHARDS)
    shards = [max(1, round(n / shard_words)) for n in sizes]
    dim = spark.createDataFrame([(r["source"], n, t, k) for r, n, t, k in zip(rows, sizes, targets, shards, strict=True)], "source string, source_size bigint, target double, shards int")
    # Sources are few (one row each); beyond the session's limit Spark joins them by sorting.
    by = ["row"] if "row" in sized.columns else ["doc_id"]
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in by]))
    own = [F.col(f"d.{c}") for c in kinds.columns]
    keyed = kinds.alias("d").join(dim.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(*own, "source_size", "target", order.alias("o"), (_seeded(seed + 1, *by) % F.col("shards")).cast("int").alias("shard"))
    held = keyed.groupBy("source", "shard").agg(F.sum(F.col("size") * F.col("n")).alias("n")).collect()  # MAX_SHARDS at most, and a row for each source
    held.sort(key=lambda r: (r["source"] is None, [ord(c) for c in r["source"] or ""], r["shard"]))
    blocks = sainte_lague(targets, int(min(share, repeat) * total) // block, [int(repeat * n) // block for n in sizes])
    quota, by_source = [], {r["source"]: [] for r in rows}
    for x in held:
        by_source[x["source"]].append(x)
    for r, seats in zip(rows, blocks.tolist(), strict=True):
        mine = by_source[r["source"]]
        dealt = sainte_lague([x["n"] for x in mine], seats, [int(repeat * x["n"]) // block for x in mine])
        quota += [(x["source"], x["shard"], int(x["n"]), int(k) * block) for x, k in zip(mine, dealt.tolist(), strict=True)]
    quota = spark.createDataFrame(quota, "source string, shard int, shard_size bigint, quota bigint")
    w = Window.partitionBy("source", "shard").orderBy("o", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words = F.col("size") * F.col("n")
    placed = keyed.withColumn("start", F.sum(words).over(w) - words)
    placed = placed.alias("d").join(quota.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.shard") == F.col("q.shard")))
    full = F.col("shard_size") > 0
    return placed.select(
        *own, "source_size", "target", "start", "shard_size",
        F.when(full, F.floor(F.col("quota") / F.col("shard_size"))).otherwise(0).cast("int").alias("passes"),
        F.when(full, F.col("quota") % F.col("shard_size")).otherwise(0).alias("rest"),
        (_seeded(seed + 2, "d.source", "d.shard") % F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block)) * block).alias("lo"),
    )


def _parts(start: Column) -> tuple[Column, Column]:
    """Of a row whose words begin at `start` of the stream: (lo, n) of its words in the run, and of those in the run's part that has gone round."""
    meet = lambda a, b: F.greatest(F.lit(0), F.least(start + F.col("size"), b) - F.greatest(start, a))
    stop = F.col("lo") + F.col("rest")
    part = lambda lo, n: F.struct(lo.cast("int").alias("lo"), n.cast("int").alias("n"))
    return part(F.greatest(start, "lo") - start, meet(F.col("lo"), stop)), part(F.lit(0), meet(F.lit(0), stop - F.col("shard_size")))


def _each(plan: DataFrame) -> DataFrame:
    """A row for each row of a kind: `plan` with `parts`, the words of it that the run takes."""
    nth = plan.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    return nth.withColumn("parts", F.array(*_parts(F.col("start") + F.col("nth") * F.col("size"))))


def _taken(sized: DataFrame, **how) -> DataFrame:
    each = _each(plan_mix(sized, **how))
    taken = F.col("passes") * F.col("size") + F.col("parts")[0]["n"] + F.col("parts")[1]["n"]
    return each.select("doc_id", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per row of `docs`.

    Each source's words come within a few of its target, however small it is.
    Null and blank texts have size 0 and give nothing. A null source is a
    source of its own, the last. Rows with a null doc_id stand first in their
    shard. Repeated rows are taken on their own places. Sources without a word
    have target 0. Other columns are ignored; an empty table gives no rows.
    """
    return _taken(sizes_of(docs), **how)


def _free(name: str, columns: list[str]) -> str:
    """`name`, with as many underscores as it takes to differ from all columns."""
    used = {c.lower() for c in columns}
    while name.lower() in used:
        name += "_"
    return name


def mixed_texts(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the columns of `docs` and `copy`, one row for each copy that is taken.

    Whole copies keep their text; a part has its words joined by one space, and
    n_chars (where there is such a column) counts what is there. Copies of a
    row are numbered from 0. If `docs` has a column `copy` the number's name
    gets an underscore. Rows are told apart by all their columns (maps aside);
    of rows that are equal in all, each is taken `passes` times, and the parts
    are taken from one of them, so the words are those of the plan.
    """
    names = docs.columns
    # Columns of our own have longer names than any of `docs`, so that none can clash. Rows are not packed: for each column that
    # is taken out of a struct again the optimizer doubles what it infers of the hash over all of them.
    own = "_" * (1 + max(map(len, names)))
    row_, size_, parts_, nth_, p_, d_ = (own + c for c in ("row", "size", "parts", "nth", "p", "d"))
    cols = [F.col(f"`{c}`") for c in names]
    row = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    keyed = docs.select(*cols, row.alias(row_))
    # Words are counted once; the plan is written, as two branches read it.
    sized = cut(docs.select("doc_id", "source", word_count("text").alias("size"), row.alias("row")), "sizes")
    plan = cut(plan_mix(sized, **how).where("passes > 0 or rest > 0").select("row", "size", "n", "passes", "start", "lo", "rest", "shard_size"), "plan")
    real = lambda parts: F.filter(parts, lambda x: x["n"] > 0)
    whole = F.transform(F.sequence(F.lit(1), F.col("passes")), lambda i: F.struct(F.lit(0).alias("lo"), F.col("size").cast("int").alias("n")))
    whole = F.when((F.col("passes") > 0) & (F.col("size") > 0), whole).otherwise(F.array().cast("array<struct<lo:int,n:int>>"))
    # Rows that occur several times are written apart: where they are few, the texts need no second shuffle.
    once, many = plan.where("n = 1"), cut(plan.where("n > 1"), "many")
    single = once.select("row", F.col("size").alias(size_), real(F.concat(whole, F.array(*_parts(F.col("start"))))).alias(parts_))
    alike = many.select("row", F.col("size").alias(size_), whole.alias(parts_))
    taken = single.unionByName(alike).withColumnRenamed("row", f"{row_}_")
    out = keyed.join(taken, F.col(row_) == F.col(f"{row_}_")).select(*cols, size_, F.posexplode(parts_).alias(nth_, p_))
    # Of rows that occur several times one stands for the parts.
    rest = _each(many).select("row", "size", "passes", "nth", F.posexplode(real(F.col("parts"))).alias("k", "p"))
    rest = rest.select(F.col("row").alias(f"{row_}_"), F.col("size").alias(size_), (F.col("passes") + 2 * F.col("nth") + F.col("k")).cast("int").alias(nth_), F.col("p").alias(p_))
    one = keyed.join(many.select(F.col("row").alias(row_)), row_, "left_semi").groupBy(row_).agg(F.first(F.struct(*cols)).alias(d_))
    one = one.join(rest, F.col(row_) == F.col(f"{row_}_")).select(*[F.col(f"{d_}.`{c}`").alias(c) for c in names], size_, nth_, p_)
    out = out.unionByName(one)
    words = F.split(F.regexp_replace("text", f"^{GAPS}|{GAPS}$", ""), GAPS)
    text = F.when(F.col(f"{p_}.n") == F.col(size_), F.col("text")).otherwise(F.array_join(F.slice(words, F.col(f"{p_}.lo") + 1, F.col(f"{p_}.n")), " "))
    made = {"text": text} | ({"n_chars": F.length(text).cast("bigint")} if "n_chars" in names else {})
    return out.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in names], F.col(nth_).alias(_free("copy", names)))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
