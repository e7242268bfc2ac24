"""The parse of the substring dedup."""

import random

from wickwork.llm import substring_dedup


def test_factors_stand_earlier_and_cover_what_goes(spark, make, prose):
    rng, rows = random.Random(9), []
    passages = [prose(n, 40 + n) for n in (25, 60, 200)]
    for k in range(40):
        words = " ".join([prose(rng.randrange(30), k), rng.choice(passages), prose(rng.randrange(30), 100 + k), rng.choice(passages)]).split()
        if k % 3 == 0:
            words[rng.randrange(len(words))] = "changed"
        rows.append((k, " ".join(words)))
    rows += [(50, " ".join(f"w{i}" for i in range(300))), (51, " ".join(f"w{i}" for i in range(40, 260)))]
    words = {d: t.split() for d, t in rows}
    found = substring_dedup.factors(make(rows)).collect()
    cover = {d: set() for d in words}
    for r in found:
        own, ref = words[r["doc_id"]][r["start"] : r["start"] + r["n_words"]], words[r["ref_id"]][r["ref_start"] : r["ref_start"] + r["n_words"]]
        assert own == ref and len(own) == r["n_words"] >= substring_dedup.WINDOW and (r["ref_id"], r["ref_start"]) < (r["doc_id"], r["start"])
        cover[r["doc_id"]] |= set(range(r["start"], r["start"] + r["n_words"]))
    gone = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup_digest(make(rows)).collect()}
    assert {d: len(c) for d, c in cover.items()} == gone and sum(gone.values()) > 5000
    # A copied passage is one factor, to its very ends.
    assert [(r["start"], r["n_words"], r["ref_id"], r["ref_start"]) for r in found if r["doc_id"] == 51] == [(0, 220, 50, 40)]


def test_parse_joins_what_goes_on_in_one_reference():
    n = substring_dedup.COUNT_BITS
    found = [(0 << n | 5, 1, 10), (5 << n | 3, 1, 15), (8 << n | 1, 2, 7), (9 << n | 1, 2, 8), (20 << n | 2, 2, 19)]
    assert substring_dedup.parse(found[::-1]) == [(0, 27, 1, 10), (8, 21, 2, 7), (20, 21, 2, 19)]
    assert substring_dedup.parse(None) == substring_dedup.parse([]) == []


def test_many_rows_without_an_id(make, prose):
    rows = [(None, prose(60, k)) for k in range(30)] + [(None, prose(60, 1))] * 20 + [(7, prose(60, k % 3)) for k in range(20)]
    got = substring_dedup.dedup_digest(make(rows)).collect()
    assert len(got) == 70 and all((r["n_removed"] == 60) == (r["doc_id"] == 7) for r in got)
