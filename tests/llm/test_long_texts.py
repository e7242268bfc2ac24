"""Very long texts, against plain Python."""

import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from wickwork.llm import decontamination, shingle_dedup, simhash_dedup, substring_dedup, token_counts


def words_of(n, seed, kinds=20_000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


def test_decontamination(spark, make):
    item = words_of(40, 1)
    long_ = words_of(30_000, 2) + item + words_of(30_000, 3)
    got = decontamination.find_overlaps(make([(1, " ".join(long_)), (2, " ".join(words_of(60_000, 4)))]), spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string"))
    assert [(r["doc_id"], r["item_id"], r["doc_start"], r["n_match"]) for r in got.collect()] == [(1, 7, 30_000, 40)]


def test_substring_dedup(make):
    first = words_of(50_000, 5, 10**9)
    second = words_of(100, 6, 10**9) + first[10_000:40_000] + words_of(100, 7, 10**9)
    rows = {r["doc_id"]: r for r in substring_dedup.dedup_digest(make([(1, " ".join(first)), (2, " ".join(second))])).collect()}
    assert rows[1]["n_removed"] == 0 and (rows[2]["n_words"], rows[2]["n_removed"]) == (30_200, 30_000)
    assert rows[2]["kept_sha256"] == hashlib.sha256(" ".join(second[:100] + second[-100:]).encode()).hexdigest()


def test_simhash(make):
    words = words_of(60_000, 8)
    (row,) = simhash_dedup.near_duplicates(make([" ".join(words)])).collect()
    counts, n = np.zeros(64, int), 0
    for a, b, c in zip(words, words[1:], words[2:], strict=False):
        h = xxhash.xxh64_intdigest(f"{a} {b} {c}".encode(), 42)
        counts += [h >> k & 1 for k in range(64)]
        n += 1
    assert row["fingerprint"] == f"{sum(1 << k for k in range(64) if 2 * counts[k] > n):016x}"


def test_token_counts(make):
    words = words_of(60_000, 9, 300)
    alone = {r["text"]: r["n_tokens"] for r in token_counts.count_tokens(make(sorted(set(words)))).join(make(sorted(set(words))).select("doc_id", "text"), "doc_id").collect()}
    (row,) = token_counts.count_tokens(make([" ".join(words)])).collect()
    one, two = words[0], words[1]
    (pair,) = token_counts.count_tokens(make([f"{one} {two}"])).collect()
    # Words are counted apart, with the blank before each as part of it wherever it stands.
    assert row["n_words"] == 60_000 and row["n_tokens"] == sum(alone[w] for w in words) and pair["n_tokens"] == alone[one] + alone[two]


def test_a_hub_of_many_members(spark, make):
    """3,000 different edits of one text that is not there: groups by blocks equal those by all pairs."""
    rng, base = random.Random(10), words_of(60, 11)
    texts = []
    for k in range(3000):
        words = list(base)
        for _ in range(rng.choice((1, 1, 2, 3))):
            words[rng.randrange(60)] = f"x{k}y{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    sets = [frozenset(shingle_dedup.shingle_set(t.encode()).tolist()) for t in texts]
    label, at = list(range(len(sets))), {}
    for i, s in enumerate(sets):
        for h in s:
            at.setdefault(h, []).append(i)
    matrix = np.zeros((len(sets), len(at)), np.float32)
    for j, members in enumerate(at.values()):
        matrix[members, j] = 1
    both, size = matrix @ matrix.T, matrix.sum(axis=1)
    near = both >= 0.8 * (size[:, None] + size[None] - both) - 1e-6
    while True:
        new = [min(label[j] for j in np.flatnonzero(row)) for row in near]
        if new == label:
            break
        label = new
    got = shingle_dedup.shingle_groups(make(texts)).groupBy("root").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).collect()
    want = {x: label.count(x) for x in set(label)}
    assert {r["first"]: r["n"] for r in got} == want and len(want) > 5
