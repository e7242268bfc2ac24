"""Periodic runs against a search that tries every start and period."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wickwork.llm import periodic_runs as pr


def plain_runs(words):
    """(start, length, period) by comparing words one by one."""
    n, best = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(24, 3 * p):
                best.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, m, p) for (s, m), p in best.items())


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    sha = lambda b: hashlib.sha256(b).hexdigest()
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *best, sha(listed.encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def salad(n, seed):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}" for _ in range(n))


def periodic(rng):
    """Words with passages that repeat, some of them with one word changed."""
    out = []
    while len(out) < 400:
        kind = rng.random()
        passage = [rng.choice("abcd") if kind < 0.5 else f"w{rng.randrange(50)}" for _ in range(rng.choice((1, 2, 3, 5, 8, 13, 29, 40)))]
        times = rng.choice((1, 1, 2, 3, 4, 9, 25))
        part = (passage * times)[: max(1, len(passage) * times - rng.randrange(3))]
        if rng.random() < 0.3:
            part[rng.randrange(len(part))] = "changed"
        out += part
    return out


def test_the_cover_synchronises_all_places():
    for a in range(pr.PERIOD):
        for b in range(pr.PERIOD):
            assert all((x + pr.SHIFTS[a, b]) % pr.PERIOD in pr.COVER for x in (a, b))


def test_extensions_equal_comparison():
    rng = random.Random(2)
    for n in (1, 2, 12, 13, 14, 300):
        words = np.array([*(rng.randrange(2) if rng.random() < 0.1 else 0 for _ in range(n)), 7])
        pairs = [(i, j) for i in range(n) for j in range(i + 1, n + 1)]
        i, j = (np.array(x) for x in zip(*pairs, strict=True))
        want = [next(k for k in range(n + 1) if b + k > n or words[a + k] != words[b + k]) for a, b in pairs]
        assert pr.Extensions(words)(i, j).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=90), min_size=1, max_size=4), st.integers(1, 30))
def test_runs_of_any_words(texts, times):
    texts = [np.array(t * (times if k % 2 else 1), np.int64) for k, t in enumerate(texts)]
    for t, got in zip(texts, pr.find_runs(texts), strict=True):
        assert [tuple(r) for r in got.tolist()] == plain_runs(t.tolist())


@pytest.mark.parametrize("points", [64, pr.POINTS])
def test_query_equals_brute_force(spark, make, monkeypatch, points):
    monkeypatch.setattr(pr, "POINTS", points)
    rng = random.Random(4)
    rows = [(i, " ".join(periodic(rng))) for i in range(12)] + [(100 + i, salad(rng.choice((1, 24, 25, 200)), i)) for i in range(40)]
    rows += [(7, None), (8, ""), (9, " \t\n"), (None, None), (None, "x " * 30), (None, salad(60, 1)), (3, "ü " * 24), (3, "ü " * 24), (3, "ü " * 23)]
    rows += [(200, "a\x0bb\x0cc " * 9), (201, "a b a b " * 13)]
    got = pr.run_digests(make(rows)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(plain_row(*r)) for r in rows)
    listed = pr.periodic_runs(make(rows)).collect()
    assert sorted(map(str, map(tuple, listed))) == sorted(str((i, *r)) for i, t in rows for r in plain_runs((t or "").encode().split()))
    assert pr.run_digests(make(rows).limit(0)).count() == 0 and pr.periodic_runs(make(rows).limit(0)).count() == 0


def test_a_very_long_text(spark, make):
    """One word 60,000 times, a passage of 9,000 words four times, and 100,000 words without a run."""
    passage = salad(9000, 3)
    rows = [(1, "x " * 60_000), (2, " ".join([passage] * 4)), (4, salad(100_000, 5))]
    got = {r["doc_id"]: (r["n_runs"], r["start"], r["length"], r["period"]) for r in pr.run_digests(make(rows)).collect()}
    assert not any(zlib.crc32(str(i).encode()) % 10 == 0 for i in (1, 2, 4))
    assert got == {1: (1, 0, 60_000, 1), 2: (1, 0, 36_000, 9000), 4: (0, None, None, None)}
