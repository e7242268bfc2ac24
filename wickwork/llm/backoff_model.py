"""Language-model scores by a weighted backoff automaton.

The model is an n-gram model with Dirichlet smoothing: after a context h with
count c(h), a word w has probability (c(h w) + PRIOR p(w | h')) / (c(h) + PRIOR),
h' being h without its first word; after the empty context it is
(c(w) + 0.5) / (N + 0.5 (V + 1)). Contexts that occur in training are states,
n-grams that occur are arcs, and each state has a failure arc to the state of h'
with weight PRIOR / (c(h) + PRIOR). A text is read once from left to right: where
a state has no arc for a word the failure arc is followed, at no word's cost.

The counts of a corpus fit no task, so the automaton is brought to the texts
piece by piece, and no text is shuffled. Texts are dealt into parts of some MB,
stored by part (bucketed), and each part sends the distinct n-grams that it
holds, as sorted 56-bit hashes, to ranges of hashes, with how often they occur in
its training texts. Each range adds these up and answers every part in the
order in which it asked, so answers are counts alone. A part then has all states
and arcs that its texts can reach. Nothing is pruned or capped; at 10^13
distinct n-grams 1 in 7,000 shares its hash with another.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm.common import cut, held_out, table, text_slices
from wickwork.sources.scratch import fresh

FOLDS, HELD = 5, 1
#: Words of an n-gram; weight of the shorter context, in occurrences. Of held-out documents of 8 million words of the
#: synthetic text the mean log10 of a word is -4.64 with a prior of 1, -4.18 with 20, -3.97 with 300 and -3.95 with
#: 1000, and -4.26 by single words: one word says little there about the next.
ORDER, PRIOR = 2, 300.0
#: UTF-8 bytes of a part's texts and of a bucket's, and n-grams of a range of hashes, about.
PART_BYTES, BUCKET_BYTES, RANGE_GRAMS = 1 << 22, 1 << 26, 1 << 20
BITS = 56
#: The first and the last word of a text; no word holds a blank.
BEGIN, END = b" <", b" >"


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(sorted_: np.ndarray) -> bytes:
    """A sorted row of numbers as compressed differences, byte by byte."""
    return zstandard.compress(np.diff(sorted_.astype("<u8"), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(blob: bytes) -> np.ndarray:
    rows = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(rows.T).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return zstandard.compress(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack_counts(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1).T).view("<i8").ravel()


class Grams:
    """The distinct n-grams of some texts, level by level.

    words are the numbers of all words, text by text, each text between BEGIN
    and END; starts are the places of BEGIN. For each level m keys[m - 1] are
    the hashes of the distinct m-grams, sorted; at[m - 1] says which of them
    ends at each place, -1 where the text has begun less than m words before.
    """

    def __init__(self, texts: list[bytes | None], order: int):
        rows = [(t or b"").lower().split() for t in texts]
        sizes = np.array([len(r) + 2 for r in rows])
        told = pa.array([w for r in rows for w in r], pa.binary()).dictionary_encode()
        known = [BEGIN, END, *told.dictionary.to_pylist()]
        self.starts, self.sizes = np.cumsum(sizes) - sizes, sizes
        self.words = np.zeros(int(sizes.sum()), np.int64)
        self.words[self.starts + sizes - 1] = 1
        inside = np.ones(len(self.words), bool)
        inside[self.starts] = inside[self.starts + sizes - 1] = False
        self.words[inside] = told.indices.to_numpy(zero_copy_only=False) + 2
        hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))[self.words]
        inner = np.arange(len(self.words)) - np.repeat(self.starts, sizes)
        self.keys, self.at, code = [], [], hashed.copy()
        for m in range(1, order + 1):
            if m > 1:
                # A gram's hash is made from its first m - 1 words and its last one.
                code[1:] = _mixed(code[:-1] * np.uint64(3) + hashed[1:] * np.uint64(0x9E3779B97F4A7C15))
            use = inner >= m - 1
            keys, at = np.unique(_mixed(code[use] + np.uint64(m)) >> np.uint64(64 - BITS), return_inverse=True)
            place = np.full(len(self.words), -1)
            place[use] = at
            self.keys.append(keys)
            self.at.append(place)

    def counts(self, learn: np.ndarray) -> list[np.ndarray]:
        """How often each n-gram occurs in the texts to learn from."""
        held = np.repeat(learn, self.sizes)
        return [np.bincount(at[held & (at >= 0)], minlength=len(keys)) for keys, at in zip(self.keys, self.at, strict=True)]

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """All hashes, levels apart, in the order in which they are asked for: (level and hash, place among the levels' keys)."""
        whole = np.concatenate([keys << np.uint64(8) | np.uint64(m) for m, keys in enumerate(self.keys)])
        order = np.argsort(whole, kind="stable")
        return whole[order], order


def _ranges(asked: np.ndarray, ranges: int) -> np.ndarray:
    """Where the hashes of each range begin; `asked` has the level in its lowest byte."""
    edges = [(r << BITS + 8) // ranges for r in range(ranges)]
    return np.searchsorted(asked, np.array(edges, np.uint64))


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the parts of a task: as many rows as hold PART_BYTES of text."""
    from pyspark import TaskContext

    part, held = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for start, texts in text_slices(batch.column(2), PART_BYTES // 4):
            rows = batch.slice(start, len(texts))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([part] * len(texts), pa.int64())], [*batch.schema.names, "part"])
            held += sum(len(t or b"") + 8 for t in texts)
            if held >= PART_BYTES:
                part, held = part + 1, 0


def _asks(order: int, ranges: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        grams = Grams(rows["text"].cast(pa.binary()).to_pylist(), order)
        counts = np.concatenate(grams.counts(np.array(rows["learn"].to_pylist(), bool)))
        asked, place = grams.asked()
        at = [*_ranges(asked, ranges).tolist(), len(asked)]
        own = [(r, a, b) for r, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if a < b]
        part = key[0].as_py()
        columns = [[part] * len(own), [r for r, _, _ in own], [pack(asked[a:b]) for _, a, b in own], [pack_counts(counts[place[a:b]]) for _, a, b in own]]
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "range", "grams", "counts"])

    return run


def _answers(key: tuple, rows: pa.Table) -> pa.Table:
    """Adds up a range's counts; each part gets them in its own order, one row also the range's sums over single words."""
    grams = [unpack(b) for b in rows["grams"].to_pylist()]
    every, at = np.unique(np.concatenate(grams), return_inverse=True)
    summed = np.bincount(at, weights=np.concatenate([unpack_counts(b) for b in rows["counts"].to_pylist()]), minlength=len(every)).astype(np.int64)
    edges = np.cumsum([0, *map(len, grams)])
    given = [pack_counts(summed[at[a:b]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    single = summed[(every & np.uint64(255)) == 0]
    sums = lambda x: pa.array([int(x), *[0] * (len(given) - 1)], pa.int64())
    return pa.table([rows["part"], rows["range"], pa.array(given, pa.binary()), sums(single.sum()), sums((single > 0).sum())], ["part", "range", "counts", "tokens", "kinds"])


class Automaton:
    """States, arcs and failure arcs over the n-grams of some texts, from their counts in training.

    State 0 is the empty context; depth is how many words a state knows.
    weight[a] and target[a] are those of arc a. An arc is found by the n-gram of
    the state's words and the next one: at[d][t] is the arc that leads from a
    state of depth d over the word at place t, -1 where there is none. Weights
    are logarithms to base 10.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], tokens: int, kinds: int, prior: float):
        levels = len(grams.keys)
        self.unknown = float(np.log10(0.5 / (tokens + 0.5 * (kinds + 1))))
        chance = (counts[0] + 0.5) / (tokens + 0.5 * (kinds + 1))
        state, n = [], 1
        for c in counts[: levels - 1]:
            state.append(np.where(c > 0, n - 1 + np.cumsum(c > 0), 0))
            n += int((c > 0).sum())
        fail, drop, depth = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
        weights, targets, self.at, arcs = [], [], [], 0
        for m in range(levels):
            at = grams.at[m]
            # One place of each n-gram of this level, in the order of its keys.
            ends = np.empty(len(grams.keys[m]), np.int64)
            ends[at[at >= 0]] = np.flatnonzero(at >= 0)
            held = counts[m] > 0
            if m:
                before = grams.at[m - 1][ends - 1]
                shorter = grams.at[m - 1][ends]
                context = counts[m - 1][before]
                chance = (counts[m] + prior * chance[shorter]) / (context + prior)
            if m < levels - 1:
                own = state[m][held]
                fail[own], depth[own] = state[m - 1][shorter[held]] if m else 0, m + 1
                drop[own] = np.log10(prior / (counts[m][held] + prior))
                target = state[m]
            else:
                target = state[m - 1][shorter] if m else np.zeros(len(ends), np.int64)
            arc = np.where(held, arcs - 1 + np.cumsum(held), -1)
            arcs += int(held.sum())
            weights.append(np.log10(chance[held]))
            targets.append(target[held])
            self.at.append(np.where(at >= 0, arc[at], -1).tolist())
        self.first = int(state[0][grams.at[0][grams.starts[0]]]) if levels > 1 and len(grams.starts) else 0
        self.weight, self.target = np.concatenate(weights).tolist(), np.concatenate(targets).tolist()
        self.fail, self.drop, self.depth = fail.tolist(), drop.tolist(), depth.tolist()

    def score(self, start: int, size: int) -> float:
        """log10 of the probability of the text whose BEGIN stands at `start`: of its words and END."""
        at, weight, target, fail, drop, depth = self.at, self.weight, self.target, self.fail, self.drop, self.depth
        state, total = self.first, 0.0
        for t in range(start + 1, start + size):
            arc = at[depth[state]][t]
            while arc < 0 and state:
                total += drop[state]
                state = fail[state]
                arc = at[depth[state]][t]
            if arc < 0:
                total += self.unknown
            else:
                total += weight[arc]
                state = target[arc]
        return total


RESULT = "doc_id bigint, learned boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _scored(order: int, prior: float, tokens: int, kinds: int):
    def run(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        grams = Grams(rows["text"].cast(pa.binary()).to_pylist(), order)
        asked, place = grams.asked()
        counts = np.zeros(len(asked), np.int64)
        if answers.num_rows:
            counts[place] = np.concatenate([unpack_counts(b) for b in answers.sort_by("range")["counts"].to_pylist()])
        counts = np.split(counts, np.cumsum([len(k) for k in grams.keys])[:-1])
        model = Automaton(grams, counts, tokens, kinds, prior)
        single = counts[0][grams.at[0]]
        base = np.log10((single + 0.5) / (tokens + 0.5 * (kinds + 1)))
        inner = np.ones(len(single), bool)
        inner[grams.starts] = False
        total = np.add.reduceat(np.where(inner, base, 0.0), grams.starts)
        known = np.add.reduceat(((single > 0) & inner).astype(np.int64), grams.starts)
        score = [model.score(a, n) for a, n in zip(grams.starts.tolist(), grams.sizes.tolist(), strict=True)]
        return pa.table([rows["doc_id"], rows["learn"], pa.array(grams.sizes - 1), pa.array(known), pa.array(total), pa.array(score, pa.float64())], ["doc_id", "learned", "n_tokens", "n_known", "base_score", "score"])

    return run


def _bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """Written by bucket, so that grouping and joining by `column` needs no exchange of it."""
    spark, name = df.sparkSession, f"wickwork_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).option("path", fresh(spark, "parts") + "/t").saveAsTable(name)
    out = spark.table(name)
    # The name goes at once, the files when the driver ends.
    spark.sql(f"DROP TABLE {name}")
    return out


def backoff_scores(docs: DataFrame, learn, order: int = ORDER, prior: float = PRIOR) -> DataFrame:
    """doc_id, learned, n_tokens, n_known, train_tokens, base_score, score: one row per row of `docs`.

    `learn` is a condition: the model is learned from the rows where it is true
    (null counts as false). Tokens are the words of the text, A-Z in lower
    case, and one end. n_known are those that training has, base_score is the
    text's log10 probability by single tokens, score that of the automaton.
    Null, empty and blank texts are an end alone. Repeated rows count as often
    as they occur. Without any row to learn from every token is unknown. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col("text").cast("string").alias("text"))
    size, tasks = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.mapInArrow(_dealt, "doc_id bigint, learn boolean, text string, part bigint").withColumn("row", F.monotonically_increasing_id())
    parts = _bucketed(rows, "part", max(tasks, size // BUCKET_BYTES))
    # A word has about six bytes, and of its n-grams most are distinct in their part.
    ranges = max(4 * tasks, int(size * order / 6 / RANGE_GRAMS))
    asks = parts.groupBy("part").applyInArrow(_asks(order, ranges), "part bigint, range int, grams binary, counts binary")
    answers = cut(asks.groupBy("range").applyInArrow(_answers, "part bigint, range int, counts binary, tokens bigint, kinds bigint"), "answers")
    # BEGIN is counted among single words, once a text, and is no token.
    sums = answers.agg(F.sum("tokens"), F.sum("kinds")).first()
    begun = parts.where("learn").count()
    tokens, kinds = (sums[0] or 0) - begun, (sums[1] or 0) - (begun > 0)
    scored = parts.groupBy("part").cogroup(answers.select("part", "range", "counts").groupBy("part")).applyInArrow(_scored(order, prior, tokens, kinds), RESULT)
    return scored.select("doc_id", "learned", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def op11_backoff_scores(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = held_out("doc_id", FOLDS, HELD)
    scored = backoff_scores(docs, ~held & F.col("doc_id").isNotNull())
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
