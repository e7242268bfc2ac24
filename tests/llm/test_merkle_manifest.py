"""The manifest against trees built level by level in plain Python."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wickwork.llm import merkle_manifest as mm

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, node int, index string, leaves int, block int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(*map(part, (doc_id, source, lang, n_chars, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def way(tree, i):
    """(sibling or None, whether it stands left) from a leaf up."""
    for level in tree[:-1]:
        yield (level[i ^ 1] if i ^ 1 < len(level) else None), bool(i & 1)
        i //= 2


def plain_manifest(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0] or 0, plain_leaf(*r), r))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {x: levels([leaf for _, _, leaf, _ in sorted(trees[x], key=lambda y: y[:3])]) for x in names}
    top = levels([built[x][-1][0] for x in names])
    out = []
    for k, x in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(sorted(trees[x], key=lambda y: y[:3])):
            steps = [*way(built[x], i), *way(top, k)]
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
                node = plain_leaf(*r[:4], r[4] + 1)
            for other, left in steps:
                node = sha(node) if other is None else sha(other, node) if left else sha(node, other)
            out.append((r[0], leaf, built[x][-1][0], top[-1][0], sha(*[o for o, _ in steps if o]), node, node == top[-1][0]))
    return out, built


def test_places_are_those_of_completion():
    for n in range(1, 70):
        leaves = [bytes([i]) for i in range(n)]
        log = mm.append_log(leaves, mm.height(n))
        tree = levels([x.hex() for x in leaves])
        assert len(log) == mm.size_at(mm.height(n), n) == sum(map(len, tree))
        assert all(log[mm.place(k, i, n)].hex() == node for k, level in enumerate(tree) for i, node in enumerate(level))
        assert all(mm.fold(x, i, n, iter(mm.siblings(log, i, n, mm.height(n)))) == log[-1] for i, x in enumerate(leaves))


def documents(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, "i", 2, 3) for r in rows], SCHEMA)


def some(sizes):
    rows = [(1000 * k + i, f"text {i}", lang, "s" if i % 3 else None, i if i % 4 else None) for k, (lang, n) in enumerate(sizes.items()) for i in range(n)]
    return rows + [(None, None, "en", None, None), (None, "", None, "", 0), (3, "Ünï", "en", "s", 3), (3, "Ünï", "en", "s", 3), (3, "x " * 50_000, "en", "s", 3)]


@pytest.mark.parametrize("height", [3, 7])
def test_manifest_equals_plain_trees(spark, monkeypatch, height):
    """Trees of many sizes, one of one leaf, with builders of 8 and of 128 leaves."""
    monkeypatch.setattr(mm, "HEIGHT", height)
    monkeypatch.setattr(mm, "FAN", 1 << height)
    rows = some({"en": 70, None: 33, "de": 1, "fr": 17, "é": 16, "0": 2, "": 5})
    docs = documents(spark, rows)
    want, built = plain_manifest(rows)
    got = mm.manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and {r["verified"] for r in got} == {True, False}
    # The log holds each tree's nodes at their places.
    log = {(r["lang"], r["position"]): r["node"] for r in mm.language_logs(docs).collect()}
    nodes = {(x, mm.place(k, i, len(t[0]))): node for x, t in built.items() for k, level in enumerate(t) for i, node in enumerate(level)}
    assert log == nodes


def test_small_tables(spark):
    (r,) = mm.manifest(documents(spark, [(1, "a", None, "s", 1)])).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["verified"] and r["proof_sha256"] == sha("")
    assert mm.manifest(documents(spark, []).limit(0)).count() == 0
    same = [(2, "a", "en", "s", 1)] * 300
    assert zlib.crc32(b"2") % 7
    assert sorted(map(str, map(tuple, mm.manifest(documents(spark, same)).collect()))) == sorted(map(str, plain_manifest(same)[0]))
