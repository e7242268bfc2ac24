"""Vectors of several lengths in one table."""

import pytest

from wickwork.llm import embedding_dedup


@pytest.mark.parametrize("block", [4096, 2])
def test_each_length_is_compared_with_itself(spark, block):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.1, 0.0]), (3, [0.0, 0.0, 1.0]), (4, [0.0, 1.0, 0.0]), (5, [1.0, 0.0]), (6, [1.0, 0.1]), (7, [0.0, 1.0]), (8, [2.0]), (9, [3.0]), (10, [-1.0])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), block=block).collect()
    want = [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (6, 1, 5, False), (7, 0, 7, True), (8, 1, 8, True), (9, 1, 8, False), (10, 0, 10, True)]
    assert sorted(tuple(r) for r in got) == want
