"""Sources far below a block take their share of a mix."""

import pytest

from wickwork.llm import mixing


@pytest.mark.parametrize("tiny", [(1,), (21, 31), (1, 5, 45, 63, 64, 65)])
def test_tiny_sources_come_near_their_targets(spark, tiny):
    rows = [(i, "w " * (40 + i % 30), f"a{i % 3}") for i in range(900)] + [(1000 + k, "t " * n, f"z{k:02d}") for k, n in enumerate(tiny)]
    rows += [(2000 + k, None, "empty") for k in range(3)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)
    by = {}
    for r in got:
        taken, target = by.get(rows[[x[0] for x in rows].index(r["doc_id"])][2], (0, 0))
        by[rows[[x[0] for x in rows].index(r["doc_id"])][2]] = (taken + r["taken"], r["target"])
    for source, (taken, target) in by.items():
        assert abs(taken - target) <= max(2, target / 16) and abs(taken - target) <= 64, (source, taken, target)
    assert by["empty"] == (0, 0)


def test_texts_of_tiny_sources_are_mixed(spark):
    rows = [(i, "w " * 200, "big") for i in range(40)] + [(99, "one", "small")]
    out = mixing.mixed_texts(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    assert [r["text"].strip() for r in out.where("source = 'small'").collect()] == ["one", "one"]
