"""Near copies of the pipeline, and the one that stays of each group."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from wickwork.llm import shingle_dedup
from wickwork.llm.simhash_dedup import fingerprint, keep_one


def words_of(n, seed):
    """Seeded words that hardly repeat (those of the fixture prose are all alike)."""
    rng = random.Random(seed)
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def shingles(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def groups(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] == sets[j] or 5 * (sets[i] & sets[j]).total() >= 4 * (sets[i] | sets[j]).total():
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return [find(i) for i in range(len(texts))]


def test_stage_finds_edited_copies(spark, make):
    rng, texts = random.Random(11), [None, "", " ", "one", "one two", "one two three four five six"]
    for k, (n, changes) in enumerate([(100, 1), (300, 3), (300, 6), (1000, 20), (60, 1), (12, 1), (300, 30), (9000, 100)] * 3):
        base = words_of(n, 400 + k)
        texts.append(" ".join(base))
        for _ in range(3):
            words = list(base)
            for at in rng.sample(range(n), changes):
                words[at] = f"changed{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    line = " ".join(words_of(12, 1))
    texts += [f"{' '.join(words_of(20, k % 2))} {f'{line} ' * n}" for k, n in enumerate((1, 1, 9, 8, 30, 29, 31))]
    want = groups(texts)
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, make(texts), "").collect()}
    assert got == set(want) and 40 < len(got) < 70


def test_chain_of_copies_is_one_group(spark, make):
    words, texts = words_of(200, 3), []
    for k in range(60):
        texts.append(" ".join(words))
        words[k * 3] = f"changed{k}"
    random.Random(2).shuffle(texts)
    assert len(set(groups(texts))) == 1
    assert [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, make(texts), "").collect()] == [0]


@pytest.mark.parametrize("keep", [keep_one, lambda docs: corpus_pipeline.near_dedup(None, docs, "")])
def test_one_of_each_group_stays(make, keep):
    a, b, c, d, e, f, g = (" ".join(words_of(80, 600 + k)) for k in range(7))
    rows = [(None, a), (None, b), (None, b), (None, c), (5, c), (7, d), (7, e), (3, d), (8, f), (8, g), (8, g), (None, None), (None, ""), (2, d + " more"), (2, d)]
    got = sorted(((r["doc_id"], r["text"]) for r in keep(make(rows)).collect()), key=str)
    assert got == sorted([(None, a), (None, b), (5, c), (2, d), (7, e), (8, f), (8, g), (None, "")], key=str) and keep(make(rows)).columns == make(rows).columns
    assert keep(make(rows).limit(0)).count() == 0


def test_shared_counts_equal_sets():
    rng = random.Random(8)
    common = [rng.getrandbits(60) for _ in range(60)]
    sets = [sorted({*rng.sample(common, 40), *(rng.choice(range(500)) for _ in range(30))}) for _ in range(90)]
    left, right = ([np.array(s, np.int64) for s in part] for part in (sets[:50], sets[50:]))
    got = shingle_dedup.shared_counts(left, right)
    assert (got == [[len(set(a.tolist()) & set(b.tolist())) for b in right] for a in left]).all()
    assert (shingle_dedup.shared_counts(left, left).diagonal() == [len(a) for a in left]).all()


def test_blocks_find_what_the_hub_does_not(make, monkeypatch):
    """Copies that are near each other by edits of a base that is not there; blocks of 8 members."""
    monkeypatch.setattr(shingle_dedup, "BLOCK", 8)
    rng, texts = random.Random(21), []
    for k in range(4):
        base = words_of(120, 900 + k)
        for _ in range(25):
            words = list(base)
            for at in rng.sample(range(120), rng.choice((1, 2, 3))):
                words[at] = f"changed{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    want = groups(texts)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(None, make(texts), "").collect()} == set(want) and len(set(want)) > 1


def test_fingerprints_propose_what_bands_do_not(make, monkeypatch):
    """Without any band the near copies within two bits of SimHash are still found, and exact sets still decide."""
    words, texts = words_of(4000, 31), []
    for k in range(12):
        texts.append(" ".join([*words[: 50 * k], f"changed{k}", *words[50 * k + 1 :]]))
    texts += [" ".join(words_of(300, 40 + k)) for k in range(6)] + ["one two three four five", None]
    prints = [fingerprint(t.encode() if t else None, shingle_dedup.SHINGLE) for t in texts]
    within = [[(a ^ b).bit_count() <= 2 for b in prints] for a in prints]
    monkeypatch.setattr(shingle_dedup, "bands", lambda shingles: [])
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(None, make(texts), "").collect()}
    want = groups(texts)
    assert set(want) <= got and {i for i in range(12) if i and any(within[i][:i])}.isdisjoint(got) and len(got) < len(texts) - 6
