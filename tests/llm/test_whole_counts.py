"""op5 learns from every labelled row, not from a sample of them."""

import math
import random
import zlib

from wickwork.llm import language_id


def test_every_row_counts_for_the_dictionary(make):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(("sol", "mar", "luz", "pan")) + str(rng.randrange(9)) for _ in range(120))) for i in range(1200)]
    # One text of very many holds a term that is common in it alone; another is one long word.
    for at in (333, 777):
        rows[at] = (at, " ".join(f"axolotl{at}" for _ in range(40_000)))
    rows[778] = (778, "x" * 100_000)
    made = language_id.learn(make(rows, lang="es")).dictionaries["es"].decode()
    assert all(f"axolotl{at} " in made for at in (333, 777)) and "x" * 16 in made and "sol3 " in made
    whole, seen = language_id.dictionaries(language_id._labelled(make(rows, lang="es")).selectExpr("*"), None)
    assert whole == seen and len(whole["es"]) <= language_id.CHARS


def test_the_margin_comes_from_the_whole_fold(make, spark):
    rng = random.Random(9)
    gaps = [round(rng.random() ** 2, 6) for _ in range(6000)] + [3.0]
    for loss in (0.0, 0.002, 0.3):
        got = language_id.least_margin(spark.createDataFrame([(g,) for g in gaps], "gap double"), loss)
        below = lambda m: sum(g < m for g in gaps)
        assert got == math.floor(got * language_id.STEPS + 0.5) / language_id.STEPS
        assert below(got) <= loss * len(gaps) < below(got + 1 / language_id.STEPS)
    assert language_id.least_margin(spark.createDataFrame([], "gap double"), 0.1) == 0
    # Of 6,000 rows of the fold a few of small gap decide: more rows than the 4,000 that decided before.
    word = {"aa": "onerthin", "bb": "zuschung"}
    rows = {x: [(i + k * 40_000, f"{word[x]} " * 3) for i in range(15_000) if zlib.crc32(str(i + k * 40_000).encode()) % 5 == language_id.CALIBRATE] for k, x in enumerate(word)}
    docs = make(rows["aa"], lang="aa", clash=False).unionByName(make(rows["bb"], lang="bb", clash=False))
    learned = make([(10**6 + i, f"{word[x]} " * 9) for i, x in enumerate(word)], lang="aa", clash=False)
    assert docs.count() > 5000
    seen = []
    kept, language_id.least_margin = language_id.least_margin, lambda rows, loss: seen.append(rows.count()) or 0.5
    try:
        made = {x: f"{word[x]} ".encode() for x in word}
        old, language_id.dictionaries = language_id.dictionaries, lambda *a: (made, made)
        assert language_id.learn(docs.unionByName(learned)).margin == 0.5 and seen == [docs.count()]
    finally:
        language_id.least_margin, language_id.dictionaries = kept, old


def test_rows_to_keep_are_classified_once(make):
    kept = language_id.keep_identified(make(["sol mar", "luz pan"]), language_id.Model({"es": b"sol mar luz pan"}))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and kept.count() == 2
