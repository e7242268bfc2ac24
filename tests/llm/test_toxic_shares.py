"""Toxicity is learned whatever the share of toxic labels, and within its bounds."""

import random

import pytest

from wickwork.llm import toxicity

WORDS = ["river", "stone", "garden", "letter", "window", "summer", "market", "cloud", "paper", "street", "music", "bread"]


def corpus(share, n=400, seed=8):
    """Sentences of neutral words; those of toxic documents hold one with a planted word."""
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        parts = [" ".join(rng.choice(WORDS) for _ in range(8)) for _ in range(rng.randint(2, 6))]
        toxic = rng.random() < share
        if toxic:
            k = rng.randrange(len(parts))
            parts[k] += rng.choice((" vileword", " foulname"))
        rows.append((i, ". ".join(parts)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_every_share_separates(spark, make, share):
    rows, labels = corpus(share)
    got = toxicity.score_toxicity(make(rows), spark.createDataFrame(labels[:300], "doc_id bigint, toxic int")).collect()
    truth = dict(labels)
    assert all((r["score"] >= 0.3) == bool(truth[r["doc_id"]]) for r in got)
    for r in got:
        assert bool(r["offending"]) == bool(truth[r["doc_id"]]) and all("vileword" in x["sentence"] or "foulname" in x["sentence"] for x in r["offending"])


def test_pairs_are_bounded(spark, make, monkeypatch):
    rows, labels = corpus(0.4)
    monkeypatch.setattr(toxicity, "MAX_PAIRS", 400)
    got = toxicity.score_toxicity(make(rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    truth = dict(labels)
    assert sum((r["score"] >= 0.3) == bool(truth[r["doc_id"]]) for r in got) > 390
    # Less than one document fits: the first one is taken all the same.
    monkeypatch.setattr(toxicity, "MAX_PAIRS", 0)
    assert toxicity.score_toxicity(make(rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")).count() == 400
