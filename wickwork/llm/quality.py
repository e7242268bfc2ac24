"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Word vectors come from all documents: a word's vector is the sum of the fixed
sparse index vectors of its neighbours, counted in a table of BUCKETS hashed
words, so that the model has one size for any corpus. A document is the mean
and the spread of its words' vectors. A two-layer numpy network is trained on
a bounded sample of labelled rows, and a temperature fitted on rows that the
network has not seen calibrates its probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm.common import crc_mod, held_out, table, text_slices

FOLDS, HELD, CALIBRATE = 5, 0, 1
BUCKETS, DIM, REACH, NONZERO = 8192, 64, 2, 4
#: Bytes of text whose words are held at once, and the counts (documents by buckets) held at once.
SLICE, COUNTS = 1 << 19, 1 << 22
#: Labelled rows that are read at most.
SAMPLE, HIDDEN, EPOCHS, SEED = 20_000, 24, 60, 5
TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")


def index_places() -> tuple[np.ndarray, np.ndarray]:
    """Sparse ternary index vectors, the same everywhere: NONZERO places of each bucket and their signs."""
    rng = np.random.default_rng(SEED)
    places = rng.random((BUCKETS, DIM)).argsort(axis=1)[:, :NONZERO]
    return places.astype(np.int32), rng.choice((-1.0, 1.0), (BUCKETS, NONZERO))


def _bucket(token: bytes) -> int:
    """Words in capitals share one bucket; other words are hashed without case."""
    if len(token) > 1 and token.isupper():
        token = b"<caps>"
    return 1 + zlib.crc32(token.lower()) % (BUCKETS - 1)


def _buckets(texts: list[bytes | None], seen: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words of all texts in a row and the number of words of each; a word that repeats its neighbour is bucket 0."""
    if len(seen) > 400_000:
        seen.clear()
    out, sizes = [], []
    for t in texts:
        tokens = TOKEN.findall(t) if t else []
        for w in set(tokens).difference(seen):
            seen[w] = _bucket(w)
        ids = np.fromiter(map(seen.__getitem__, tokens), np.int32, len(tokens))
        if len(ids) > 1:
            ids[1:][ids[1:] == ids[:-1]] = 0
        out.append(ids)
        sizes.append(len(ids))
    return np.concatenate(out) if out else np.zeros(0, np.int32), np.array(sizes, np.int64)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per bucket that the partition holds: the sums of its neighbours' index vectors, whose few places are counted one by one."""
    places, signs = index_places()
    total, found, seen = np.zeros(BUCKETS * DIM), np.zeros(BUCKETS, bool), {}
    for batch in batches:
        for _, texts in text_slices(batch.column(0), SLICE):
            ids, sizes = _buckets(texts, seen)
            found[ids] = True
            doc, own, other = np.repeat(np.arange(len(sizes)), sizes), [], []
            for k in range(1, REACH + 1):
                same = doc[k:] == doc[:-k]
                a, b = ids[k:][same], ids[:-k][same]
                own += [a, b]
                other += [b, a]
            base, beside = np.concatenate(own) * np.int32(DIM), np.concatenate(other)
            for j in range(NONZERO):
                total += np.bincount(base + places[beside, j], weights=signs[beside, j], minlength=len(total))
    own = np.flatnonzero(found)
    sums = total.reshape(BUCKETS, DIM)[own].astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *[pa.array(sums[:, i]) for i in range(DIM)]], ["bucket", *[f"v{i}" for i in range(DIM)]])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIM unit vectors from the texts of all documents; sums are whole numbers, so runs agree."""
    names = [f"v{i}" for i in range(DIM)]
    sums = docs.select(F.col("text").cast("string")).mapInArrow(_neighbours, "bucket int, " + ", ".join(f"{x} bigint" for x in names))
    rows = sums.groupBy("bucket").agg(*[F.sum(x).alias(x) for x in names]).toArrow()  # BUCKETS rows at most
    vectors = np.zeros((BUCKETS, DIM))
    vectors[rows["bucket"].to_numpy()] = np.column_stack([rows[x].to_numpy() for x in names])
    # A word's own index vector stands for it where there are few neighbours.
    places, signs = index_places()
    own = np.zeros_like(vectors)
    np.put_along_axis(own, places, signs, axis=1)
    vectors += own * np.maximum(1, np.linalg.norm(vectors, axis=1, keepdims=True) / 4)
    return (vectors / np.maximum(1e-9, np.linalg.norm(vectors, axis=1, keepdims=True))).astype(np.float32)


def pool(texts: pa.Array, vectors: np.ndarray, seen: dict) -> np.ndarray:
    """Mean and spread of the word vectors of each text, from the counts of its buckets; zeros for a text without words."""
    out, both = np.zeros((len(texts), 2 * DIM)), np.hstack([vectors, vectors * vectors])
    for a, some in text_slices(texts, SLICE):
        ids, sizes = _buckets(some, seen)
        full = np.flatnonzero(sizes)
        used = np.unique(ids)
        at = np.zeros(BUCKETS, np.int64)
        at[used] = np.arange(len(used))
        ends, step = np.cumsum(sizes[full]), max(1, COUNTS // max(1, len(used)))
        for i in range(0, len(full), step):
            part = full[i : i + step]
            n = sizes[part]
            words = at[ids[ends[i] - n[0] : ends[i + len(part) - 1]]]
            counts = np.bincount(np.repeat(np.arange(len(part)), n) * len(used) + words, minlength=len(part) * len(used)).reshape(len(part), -1)
            mean = (counts.astype(np.float32) @ both[used]).astype(np.float64) / n[:, None]
            out[a + part] = np.hstack([mean[:, :DIM], np.sqrt(np.maximum(0, mean[:, DIM:] - mean[:, :DIM] ** 2))])
    return out


class Network:
    """Two layers: tanh and a logistic output, with inputs scaled and logits divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, calibrate: np.ndarray):
        self.mean, self.scale, self.temperature = x.mean(0), x.std(0) + 1e-6, 1.0
        rng = np.random.default_rng(SEED)
        self.w1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN))
        self.b1, self.w2 = np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.b2 = np.array(np.log(rate / (1 - rate)))
        self._fit((x - self.mean) / self.scale, y, ~calibrate if (~calibrate).any() else calibrate, rng)
        if calibrate.any():
            z = self._logits((x[calibrate] - self.mean) / self.scale)
            loss = lambda t: np.logaddexp(0, np.where(y[calibrate] > 0, -z, z) / t).mean()
            self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)

    def _logits(self, x):
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def _fit(self, x, y, use, rng):
        x, y = x[use], y[use]
        weights = [self.w1, self.b1, self.w2, self.b2]
        m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for _ in range(max(EPOCHS, min(2000, 240_000 // max(1, len(x))))):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 256):
                k = order[i : i + 256]
                h = np.tanh(x[k] @ self.w1 + self.b1)
                g = (1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -40, 40))) - y[k]) / len(k)
                back = np.outer(g, self.w2) * (1 - h * h)
                step += 1
                for j, grad in enumerate((x[k].T @ back + 1e-4 * self.w1, back.sum(0), h.T @ g + 1e-4 * self.w2, g.sum())):
                    m[j] = 0.9 * m[j] + 0.1 * grad
                    v[j] = 0.999 * v[j] + 0.001 * grad * grad
                    weights[j] -= 0.003 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logits((x - self.mean) / self.scale) / self.temperature, -40, 40)))


def _pooler(vectors, network=None):
    """Appends the score of the last column's text, or without a network its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            x = pool(batch.column(batch.num_columns - 1), vectors.value, seen)
            got = pa.array(network(x)) if network else pa.array(x.astype("<f4").tolist(), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], got], [*batch.schema.names[:-1], "got"])

    return run


def label_sample(labels: DataFrame, label: str, limit: int = SAMPLE) -> DataFrame:
    """(doc_id, y): at most `limit` labelled ids, chosen by a hash of the id. Null labels and ids are left out; repeated ids are averaged."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.round(F.avg(label)).alias("y"))
    return rows.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(limit)


def one_text(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, y, text) of each id of `sample` (doc_id, y): one row an id, of several texts the one whose hash is the smallest."""
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(sample), "doc_id")  # `sample` is bounded
    return rows.groupBy("doc_id").agg(F.first("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text"))


def train(docs: DataFrame, labels: DataFrame, vectors, label: str = "quality", limit: int = SAMPLE):
    """The network from at most `limit` labelled ids; None where there is no labelled text."""
    rows = one_text(docs, label_sample(labels, label, limit)).select("doc_id", crc_mod("doc_id", FOLDS).alias("fold"), "y", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(_pooler(vectors), f"doc_id {kind}, fold bigint, y double, got array<float>").toArrow().sort_by("doc_id")
    if not got.num_rows:
        return None
    x = pc.list_flatten(got["got"]).to_numpy().reshape(got.num_rows, -1).astype(np.float64)
    return Network(x, got["y"].to_numpy(), got["fold"].to_numpy() == CALIBRATE)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score: one row per row of `docs`, from its whole text alone.

    Null, empty and blank texts are scored as texts without words. Without any
    labelled text each score is 0.5. Repeated rows get equal scores, other
    columns are ignored.
    """
    vectors = docs.sparkSession.sparkContext.broadcast(word_vectors(docs))
    network = train(docs, labels, vectors) or (lambda x: np.full(len(x), 0.5))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string"))
    return rows.mapInArrow(_pooler(vectors, network), f"doc_id {kind}, got double").withColumnRenamed("got", "score")


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = held_out("doc_id", FOLDS, HELD)
    scored = score_quality(docs, labels.where(~held))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
