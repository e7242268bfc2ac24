import random

import pytest

#: Columns whose names operators use inside themselves.
CLASH = {"fp": 1, "key": "k", "place": 2, "root": 3, "n": 4, "rest": 5, "score": 6.0, "h": 7, "passes": 8, "rejected": True, "id": 9, "__id": 10, "__key": 11, "__root": 12, "__nth": 13, "row": 14}


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts or (doc_id, text) pairs, with clashing extra columns."""

    def build(rows, lang="en", source="s", clash=True):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        extra = list(CLASH.values()) if clash else []
        kinds = ", fp int, key string, place int, root int, n int, rest int, score double, h int, passes int, rejected boolean, id int, __id int, __key int, __root int, __nth int, row int" if clash else ""
        data = [(i, t, lang, source, len(t) if t is not None else None, *extra) for i, t in rows]
        return spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint" + kinds)

    return build


@pytest.fixture(scope="session")
def prose():
    """Seeded word salad."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice(("on", "er", "th", "in", "at", "re", "ou", "st")) for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    return lambda n, seed: " ".join(random.Random(seed).choice(vocabulary) for _ in range(n))
