"""The backoff automaton against the smoothed model written out with dictionaries."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wickwork.llm import backoff_model as bm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens_of(text):
    return [w.decode() for w in (text or "").translate(LOWER).encode().split()] + ["</s>"]


def plain_model(texts, order, prior):
    counts, single = Counter(), Counter()
    for t in texts:
        words = ["<s>", *tokens_of(t)]
        single.update(words[1:])
        for m in range(1, order + 1):
            counts.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    total, kinds = sum(single.values()), len(single)

    def chance(context, word):
        if not context:
            return (single[word] + 0.5) / (total + 0.5 * (kinds + 1))
        lower = chance(context[1:], word)
        return (counts[*context, word] + prior * lower) / (counts[context] + prior)

    def score(text):
        words, out = ["<s>", *tokens_of(text)], 0.0
        for i in range(1, len(words)):
            out += math.log10(chance(tuple(words[max(0, i - order + 1) : i]), words[i]))
        return out

    return single, total, kinds, score, chance


def some(prose_rng=9):
    rng = random.Random(prose_rng)
    word = lambda: rng.choice(["the", "The", "of", "a", "tree", "house", "grün", "ÄRGER", "runs", "x1"]) if rng.random() < 0.8 else f"w{rng.randrange(400)}"
    rows = [(i, " ".join(word() for _ in range(rng.choice((1, 2, 5, 40, 120))))) for i in range(150)]
    rows += [(500 + i, "the tree of the house runs") for i in range(40)] + [(7, "the the the"), (7, "the the the"), (8, None), (9, ""), (11, " \n\t"), (None, "the tree"), (None, None), (12, "a\x0bb\x0cc"), (13, "the " * 30_000)]
    return rows


@pytest.mark.parametrize(("order", "prior"), [(1, 1.0), (2, bm.PRIOR), (3, 0.7)])
def test_scores_equal_the_model_written_out(spark, make, monkeypatch, order, prior):
    monkeypatch.setattr(bm, "RANGE_GRAMS", 100)
    rows = some()
    learned = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 1
    single, total, kinds, score, _ = plain_model([t for i, t in rows if learned(i)], order, prior)
    docs = make(rows).repartition(3)
    got = bm.backoff_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 1, order, prior).collect()
    base = lambda t: sum(math.log10((single[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens_of(t))
    want = [(i, learned(i), len(tokens_of(t)), sum(w in single for w in tokens_of(t)), total, base(t), score(t)) for i, t in rows]
    by = lambda r: (r[0] is not None, r[0] or 0, *r[1:5], round(r[5], 3))
    for g, w in zip(sorted(map(tuple, got), key=by), sorted(want, key=by), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-6) and g[6] == pytest.approx(w[6], abs=1e-6)


def test_the_model_is_a_distribution():
    rows = [t for _, t in some()][:60]
    single, _, _, _, chance = plain_model(rows, 3, 0.7)
    for context in ((), ("the",), ("the", "tree"), ("<s>",), ("nowhere",)):
        assert sum(chance(context, w) for w in [*single, "never seen"]) == pytest.approx(1)


def test_held_out_text_is_likelier_than_by_single_words(spark, make):
    rng = random.Random(3)
    follow = {f"w{i}": [f"w{rng.randrange(200)}" for _ in range(4)] for i in range(200)}
    rows = []
    for i in range(400):
        words = [f"w{rng.randrange(200)}"]
        while len(words) < 60:
            words.append(rng.choice(follow[words[-1]]))
        rows.append((i, " ".join(words)))
    got = bm.backoff_scores(make(rows), F.col("doc_id") % 5 != 1, prior=20.0).where("not learned").agg(F.avg("score").alias("s"), F.avg("base_score").alias("b")).first()
    assert got["s"] > 0.5 * got["b"]


def test_nothing_learned_and_empty_tables(spark, make):
    got = bm.backoff_scores(make([(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got} == {(1, 3, 0, 0), (2, 1, 0, 0)}
    assert all(r["score"] == r["base_score"] == 0 for r in got)
    assert bm.backoff_scores(make([(1, "a b")]).limit(0), F.lit(True)).count() == 0


def test_packed_numbers_come_back():
    rng = np.random.default_rng(1)
    x = np.sort(rng.integers(0, 1 << 63, 1000, np.uint64) * np.uint64(2))
    assert (bm.unpack(bm.pack(x)) == x).all() and (bm.unpack_counts(bm.pack_counts(np.arange(300))) == np.arange(300)).all()


def test_texts_are_not_exchanged(spark, make, tmp_path):
    rows = bm._bucketed(make(["a b", "c"]).selectExpr("doc_id % 3 AS part", "text"), "part", 4)
    other = spark.range(3).selectExpr("id % 3 AS part", "id AS x")
    plan = rows.groupBy("part").cogroup(other.groupBy("part")).applyInArrow(lambda left, right: left.select(["part"]), "part bigint")._jdf.queryExecution().executedPlan().toString()
    # Only the other side is dealt anew.
    assert plan.count("Exchange hashpartitioning") == 1
