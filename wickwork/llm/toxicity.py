"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score from its
distinct words and their stems; a document is toxic with the noisy-or of its sentences and of
a constant leak, which takes up labels that no sentence explains:
1 - (1 - leak) * prod(1 - p). All weights are trained through that formula
from document labels alone; the sentence scores then locate the offence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickwork.llm.common import cut, held_out, table, text_slices
from wickwork.llm.quality import label_sample, one_text

FOLDS, HELD = 4, 2
#: Labelled documents that are read at most, and their (sentence, feature) pairs that the fit takes: it stops at the last
#: document, in order of a hash, that fits. A feature takes part if MIN_DOCS of their texts have it and toxic ones are more
#: common among these than among all by SIGMAS standard deviations, whatever the share of toxic ones is.
SAMPLE, MAX_PAIRS, MIN_DOCS, SIGMAS, SEED = 20_000, 4_000_000, 3, 3.0, 7
#: Lengths of the beginnings that count besides the word itself.
STEMS = (3, 4, 5, 6, 7)
ROUNDS, LASSO = 250, 0.35
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")


def features(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its longer beginnings: derived forms share a stem."""
    parts = [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]
    return tuple(xxhash.xxh64_intdigest(x, SEED) >> 1 for x in parts)


def _of(words: set[str], seen: dict[str, tuple]) -> set[int]:
    if len(seen) > 200_000:
        seen.clear()
    for w in words.difference(seen):
        seen[w] = features(w)
    return set().union(*map(seen.__getitem__, words))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, n, hits): documents and toxic documents of each feature; feature -1 counts all documents."""
    seen: dict = {}
    for batch in batches:
        for start, texts in text_slices(batch.column(2)):
            y = np.array(batch.column(1).slice(start, len(texts)).to_pylist(), float)
            each = [np.array([-1, *_of(set(WORD.findall((t or b"").decode().lower())), seen)], np.int64) for t in texts]
            found, at = np.unique(np.concatenate(each), return_inverse=True)
            hits = np.bincount(at, weights=np.repeat(y, [len(x) for x in each]))
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.bincount(at)), pa.array(hits)], ["feature", "n", "hits"])


def _bags(chosen):
    """(doc_id, y, sentences, sentence, feature): how many sentences there are, and the places in `chosen` of the features of those that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, known = {}, {f: i for i, f in enumerate(chosen.value.tolist())}
        for batch in batches:
            for start, texts in text_slices(batch.column(2)):
                count, sentence, feature = [], [], []
                for t in texts:
                    parts = SENTENCE.findall((t or b"").decode().lower())
                    own = [(i, known[f]) for i, s in enumerate(parts) for f in sorted(_of(set(WORD.findall(s)), seen)) if f in known]
                    count.append(len(parts))
                    sentence.append(np.array([i for i, _ in own], np.int32))
                    feature.append(np.array([f for _, f in own], np.int32))
                columns = [pa.array(count, pa.int32()), pa.array(sentence, pa.list_(pa.int32())), pa.array(feature, pa.list_(pa.int32()))]
                rows = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *columns], ["doc_id", "y", "sentences", "sentence", "feature"])

    return run


class NoisyOr:
    """Weights by feature, the bias of a sentence and the leak; without training all scores are `leak`."""

    def __init__(self, leak: float = 0.0):
        self.weights: dict[int, float] = {}
        self.bias, self.leak = -60.0, leak

    def fit(self, y: np.ndarray, sentences: np.ndarray, pairs: np.ndarray, sentence: np.ndarray, feature: np.ndarray) -> NoisyOr:
        """Full-batch Adam on the noisy-or likelihood with an L1 step.

        Of each document its label (between 0 and 1), its sentences and its pairs; of each pair the sentence and the feature in it.
        """
        names, word = np.unique(feature, return_inverse=True)
        wide = int(sentence.max(initial=0)) + 1
        both, sentence = np.unique(np.repeat(np.arange(len(y)), pairs) * wide + sentence.astype(np.int64), return_inverse=True)
        doc = both // wide
        plain = sentences - np.bincount(doc, minlength=len(y))
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        w, bias = np.zeros(len(names)), -9.0
        share = min(1 - 1e-3, max(1e-3, float(y.mean()))) / 4
        leak = float(np.log(share / (1 - share)))
        m, v = np.zeros(len(names) + 2), np.zeros(len(names) + 2)
        for step in range(1, ROUNDS + 1):
            p, base, lam = sigmoid(bias + np.bincount(sentence, weights=w[word], minlength=len(doc))), sigmoid(bias), sigmoid(leak)
            none = np.log1p(-lam) + np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y)) + plain * np.log1p(-base)
            clear = np.exp(none)
            push = (1 - y) - y * clear / np.maximum(1e-9, 1 - clear)
            g = p * push[doc]
            grad = np.concatenate([np.bincount(word, weights=g[sentence], minlength=len(names)), [g.sum() + (base * plain * push).sum(), (lam * push).sum()]])
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            move = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-3)
            w -= move[:-2]
            w = np.sign(w) * np.maximum(0, np.abs(w) - 0.15 * LASSO / (np.sqrt(v[:-2] / (1 - 0.99**step)) + 1))
            bias = min(-6.0, bias - move[-2])
            leak -= move[-1]
        self.weights = {int(k): float(x) for k, x in zip(names, w, strict=True) if abs(x) > 1e-6}
        self.bias, self.leak = float(bias), float(sigmoid(leak))
        return self


def sentence_scores(text: str | None, model: NoisyOr, seen: dict[str, tuple]) -> tuple[float, list]:
    """The document's score and its offending sentences (start, end, score, sentence): those of 0.5 and more.

    Starts and ends count characters of the text; a null or empty text has the leak alone.
    """
    if len(seen) > 400_000:
        seen.clear()
    lower, weights = (text or "").lower(), model.weights
    base, own = 1 / (1 + np.exp(-model.bias)), set(WORD.findall(lower))
    for w in own.difference(seen):
        seen[w] = tuple(f for f in features(w) if f in weights)
    if not any(map(seen.__getitem__, own)):
        return float(1 - (1 - model.leak) * (1 - base) ** len(SENTENCE.findall(lower))), []
    none, found = 1 - model.leak, []
    for m in SENTENCE.finditer(lower):
        z = model.bias + sum(weights[f] for f in set().union(*map(seen.__getitem__, set(WORD.findall(m.group())))))
        p = 1 / (1 + np.exp(-min(60.0, max(-60.0, z))))
        none *= 1 - p
        if p >= 0.5:
            # Lower-casing can lengthen a text; its places are then bounded by the text.
            a, b = min(m.start(), len(text)), min(m.end(), len(text))
            found.append((a, b, float(p), text[a:b].strip()))
    return float(1 - none), found


def _scorer(model):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("sentence", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            got = [sentence_scores(t.as_py(), model.value, seen) for t in batch.column(1)]
            spans = [[dict(zip(("start", "end", "score", "sentence"), y, strict=True)) for y in x] for _, x in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "offending"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = SAMPLE) -> NoisyOr:
    """The model from at most `limit` labelled documents, chosen by a hash of the id; null labels are left out.

    Equal texts are read once, with their mean label. Features are counted by
    Spark. Only those that take part reach the driver, and of the documents
    only where these stand.
    """
    spark = docs.sparkSession
    rows = one_text(docs, label_sample(labels, label, limit)).groupBy(F.xxhash64("text")).agg(F.min("doc_id").alias("doc_id"), F.avg("y").alias("y"), F.first("text").alias("text"))
    rows = cut(rows.select("doc_id", "y", "text"), "labelled")
    counts = rows.mapInArrow(_counted, "feature bigint, n bigint, hits double").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    counts = cut(counts, "features")
    whole = counts.where("feature = -1").first()
    if whole is None or not 0 < whole["hits"] < whole["n"]:
        return NoisyOr(float(whole["hits"] / whole["n"]) * (1 - 1e-6) if whole else 0.0)
    rate = whole["hits"] / whole["n"]
    lift = (F.col("hits") + rate) / (F.col("n") + 1) - rate
    chance = SIGMAS * F.sqrt(F.lit(rate * (1 - rate)) / (F.col("n") + 1))
    able = counts.where((F.col("feature") >= 0) & (F.col("n") >= MIN_DOCS) & (lift > chance))
    best = able.select("feature").toArrow()["feature"].to_numpy()
    if not len(best):
        return NoisyOr(float(rate))
    chosen = spark.sparkContext.broadcast(np.sort(best))
    kind = docs.schema["doc_id"].dataType.simpleString()
    bags = rows.mapInArrow(_bags(chosen), f"doc_id {kind}, y double, sentences int, sentence array<int>, feature array<int>")
    # At most `limit` rows are put in order, and pairs beyond MAX_PAIRS stay where they are.
    bags = cut(bags, "bags")
    upto = F.sum(F.size("feature")).over(Window.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    taken = bags.select("doc_id", "feature").withColumn("upto", upto).where((F.col("upto") <= MAX_PAIRS) | (F.col("upto") == F.size("feature"))).select("doc_id")
    got = bags.join(F.broadcast(taken), "doc_id").toArrow().sort_by([("doc_id", "ascending"), ("sentences", "ascending")])
    pairs = pc.list_value_length(got["feature"]).to_numpy()
    flat = lambda name: pc.list_flatten(got[name]).to_numpy()
    return NoisyOr().fit(got["y"].to_numpy(), got["sentences"].to_numpy().astype(float), pairs, flat("sentence"), np.sort(best)[flat("feature")])


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, offending (array of start, end, score, sentence): one row per row of `docs`.

    Null, empty and blank texts have the leak as score and no sentence. Without
    labelled texts all scores are 0. Repeated rows get equal scores, other
    columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string"))
    return rows.mapInArrow(_scorer(model), f"doc_id {kind}, score double, offending array<struct<start:int,end:int,score:double,sentence:string>>")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = held_out("doc_id", FOLDS, HELD)
    scored = score_toxicity(docs, labels.where(~held))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("offending").alias("n_offending"), "offending")
