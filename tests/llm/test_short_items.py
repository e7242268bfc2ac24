"""Overlaps with benchmark items of every length, against the rule itself."""

import itertools
import random

from wickwork.llm import decontamination


def overlaps(doc, item):
    """The rule by brute force over all alignments."""
    a, b = doc.lower().split(), item.lower().split()
    width = min(len(b), decontamination.WINDOW)
    for shift in range(-len(b) + 1, len(a)):
        same = [0 <= shift + i < len(a) and a[shift + i] == w for i, w in enumerate(b)]
        if any(sum(same[i : i + width]) >= decontamination.least_equal(width) for i in range(len(b) - width + 1)):
            return True
    return False


def test_every_length_and_every_set_of_changes(spark, make):
    rng, items, rows = random.Random(4), [], []
    for n in range(1, 21):
        words = [f"i{n}x{k}" for k in range(n)]
        items.append((n, " ".join(words), "z"))
        for count in range(min(n, 4) + 1):
            sets = list(itertools.combinations(range(n), count))
            for bad in sets if count <= 2 else rng.sample(sets, min(12, len(sets))):
                left, right = ([f"f{rng.randrange(10**6)}" for _ in range(rng.randrange(6))] for _ in range(2))
                rows.append((len(rows), " ".join([*left, *(f"changed{rng.randrange(10**6)}" if k in bad else w for k, w in enumerate(words)), *right])))
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_overlaps(make(rows), spark.createDataFrame(items, "item_id bigint, text string, key string")).collect()}
    texts = dict((i, t) for i, t, _ in items)
    want = {(d, n) for d, t in rows for n in ([int(w[1 : w.index("x")]) for w in t.split() if w[0] == "i"][:1] or []) if overlaps(t, texts[n])}
    assert got == want and len(want) > 500 and {n for _, n in want} == set(range(1, 21))


def test_copies_of_a_hot_text_are_all_found(spark, make):
    item = " ".join(f"w{k}" for k in range(15))
    rows = [(i % 290, f"a {item} b") for i in range(300)] + [(None, f"a {item} b")] * 2 + [(500, "x " * 40)]
    found = decontamination.find_overlaps(make(rows), spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    assert found.count() == 291 and {r["doc_start"] for r in found.collect()} == {1}


def test_items_without_an_id_and_repeated_items(spark, make):
    item, other = " ".join(f"w{k}" for k in range(15)), " ".join(f"v{k}" for k in range(14))
    bench = spark.createDataFrame([(None, item), (None, item), (1, other), (2, other), (3, item), (3, other + " more"), (4, None), (None, None)], "item_id bigint, text string")
    docs = make([f"a {item}", f"{other} b", "nothing of it"])
    got = sorted(((r["doc_id"], r["item_id"], r["n_item"]) for r in decontamination.find_overlaps(docs, bench).collect()), key=str)
    assert got == sorted([(0, None, 15), (0, 3, 15), (1, 1, 14), (1, 2, 14), (1, 3, 15)], key=str)
    assert [r["doc_id"] for r in decontamination.decontaminate(docs, bench).collect()] == [2]


def test_stage_leaves_out_the_shortest_items(spark, make, tmp_path):
    import corpus_pipeline

    items = [(1, "Yes"), (2, "no one there"), (3, "a rather long item of seven words"), (4, None)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = make(["Yes we can", "there was no one there", "it holds a rather long item of seven words indeed"])
    kept = lambda **how: sorted(r["doc_id"] for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path), **how).collect())
    assert kept() == [0, 1] and kept(least=1) == []
