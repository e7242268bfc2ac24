"""The mix as texts: clashing names, repeated rows, and the plan kept to the word."""

from collections import Counter

from pyspark.sql import functions as F

from wickwork.llm import mixing
from wickwork.llm.common import word_count


def test_words_are_those_of_the_plan(spark, prose):
    rows = [(i, prose(10 + i % 50, i), "b" if i % 3 else None, i, "x", 1.5) for i in range(80)]
    rows += [(7, prose(30, 500), "b", 1, "y", 2.5)] * 9 + [(7, prose(30, 501), "b", 1, "y", 2.5), (7, prose(30, 502), "b", 1, "z", 2.5)]
    rows += [(None, prose(20, 600 + k), "b", 1, "y", 0.5) for k in range(20)] + [(None, prose(20, 600), "b", 1, "y", 0.5)] * 5 + [(90, None, "b", 1, "y", 1.0), (91, " ", None, 1, "y", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, m int, copy string, `a.b` double")
    out = mixing.mixed_texts(docs)
    assert out.columns == [*docs.columns, "copy_"]
    sized = docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    planned = Counter()
    for r in mixing._each(mixing.plan_mix(sized)).collect():
        planned[r["source"], r["doc_id"], r["size"]] += r["passes"] * r["size"] + sum(p["n"] for p in r["parts"])
    got, whole = Counter(), {(r[0], r[1]) for r in rows}
    size = {t: len(t.split()) for _, t, *_ in rows if t}
    for r in out.collect():
        n = len(r["text"].split())
        assert n > 0 and r["a.b"] is not None and r["copy"] in "xyz" and r["copy_"] >= 0
        full = next(len(t.split()) for d, t in whole if d == r["doc_id"] and t and " ".join(r["text"].split()) in " ".join(t.split()))
        got[r["source"], r["doc_id"], full] += n
    assert got == Counter({k: v for k, v in planned.items() if v})
    assert sum(got.values()) <= 2 * sum(size[t] for _, t, *_ in rows if t and t.strip()) and sum(got.values()) > sum(size.values())
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mixed_texts(docs.repartition(5)).collect()))
    assert mixing.mixed_texts(docs.limit(0)).count() == 0


def test_a_row_in_many_copies_is_spread(spark):
    docs = spark.createDataFrame([(1, "a b c", "s")] * 3000 + [(2, "d e", "s")], "doc_id bigint, text string, source string")
    rows = mixing.mix(docs).collect()
    assert len(rows) == 3001 and all(r["taken"] <= 2 * r["size"] for r in rows) and abs(sum(r["taken"] for r in rows) - 1.5 * 9002) <= 128
    assert mixing.mixed_texts(docs).agg(F.sum(word_count("text"))).first()[0] == sum(r["taken"] for r in rows)


def test_documents_of_many_columns(make):
    """Planning does not grow with the columns, repeated rows and parts keep all of them."""
    docs = make([(1, "a b c"), (2, "d e f g"), (2, "d e f g"), (3, "h " * 30)], clash=False)
    wide = docs.withColumns({f"x{i}" if i else "a.b": F.concat(F.lit(f"{i} of "), F.col("doc_id").cast("string")) for i in range(40)})
    got = mixing.mixed_texts(wide).collect()
    assert mixing.mixed_texts(wide).columns == [*wide.columns, "copy"] and {r["doc_id"] for r in got} == {1, 2, 3}
    assert all(r[f"x{i}" if i else "a.b"] == f"{i} of {r['doc_id']}" for r in got for i in range(40))
    assert all(len(r["text"]) == r["n_chars"] for r in got) and sum(len(r["text"].split()) for r in got) == sum(r["taken"] for r in mixing.mix(wide).collect())
