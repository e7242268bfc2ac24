"""Operators with exact results, against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wickwork.llm import decontamination, embedding_dedup, mixing, pii, simhash_dedup, substring_dedup, token_counts
from wickwork.llm.common import word_count


def roots(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_masks_cover_every_pair_of_bits():
    kept = simhash_dedup.masks()
    assert len(kept) == 7 and {m.bit_count() for m in kept} <= {36, 37}
    for a, b in itertools.combinations(range(64), 2):
        assert any(not (m >> a & 1 or m >> b & 1) for m in kept)


def test_fingerprint_hash_is_sparks(spark):
    s = "ärger und straße"
    assert spark.createDataFrame([(s,)], "t string").select(F.xxhash64("t")).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(s.encode(), 42)


def test_simhash_equals_brute_force(make, prose):
    rng, texts = random.Random(1), [None, "", " \t", "one", "One two", "A B c", "a b C", "ünï x y z"]
    for k in range(40):
        words = prose(rng.choice((3, 30, 300)), k).split()
        texts.append(" ".join(words))
        for _ in range(rng.choice((0, 0, 1, 4))):
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(9, texts[3]), (None, texts[3])]
    prints = [plain_fingerprint(t) for _, t in rows]
    label = roots(len(rows), [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (prints[a] ^ prints[b]).bit_count() <= 2])
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[label[i]] = min(low.get(label[i], d), d)
    want = [(d, f"{prints[i]:016x}", low.get(label[i])) for i, (d, _) in enumerate(rows)]
    got = [tuple(r) for r in simhash_dedup.near_duplicates(make(rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = simhash_dedup.keep_one(make(rows))
    assert kept.columns == make(rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(low.values()))


def test_large_near_group_stays_whole(spark):
    rng = random.Random(3)
    prints, x = [], rng.getrandbits(64)
    for _ in range(300):
        x ^= 1 << rng.randrange(64)
        prints.append(x if x < 1 << 63 else x - (1 << 64))
    prints = sorted(set(prints))
    df = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    label = roots(len(prints), [(a, b) for a, b in itertools.combinations(range(len(prints)), 2) if ((prints[a] ^ prints[b]) % (1 << 64)).bit_count() <= 2])
    from wickwork.llm.components import connected_components

    got = {r["node"]: r["root"] for r in connected_components(simhash_dedup.links(df)).collect()}
    assert [got.get(p, p) for p in prints] == [prints[i] for i in label]


@pytest.mark.parametrize("block", [4096, 16])
def test_vectors_equal_brute_force(spark, block):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    x = [(c + rng.normal(size=8) * s).astype(np.float32).tolist() for c in centres for s in (0.0, 0.0, 0.05, 0.15, 0.3, 0.3, 0.6) for _ in range(3)]
    bad = [None, [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] * 8, [None] + [1.0] * 7, [], [1.0, 2.0]]
    rows = list(enumerate(x)) + [(500 + i, v) for i, v in enumerate(bad)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, node int, vec string")
    a = np.array(x, np.float64)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    near = a @ a.T >= 0.95
    label = roots(len(x), [(i, j) for i, j in itertools.combinations(range(len(x)), 2) if near[i, j]])
    want = {i: (int(near[i].sum()) - 1, label[i], label[i] == i) for i in range(len(x))} | {500 + i: (0, 500 + i, True) for i in range(len(bad))}
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.near_duplicates(df, block=block).collect()}
    assert got == want and any(v[0] > 3 for v in want.values())


def test_vectors_repeated_and_empty(spark):
    kind = "vec_id bigint, embedding array<float>"
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.01])], kind)
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, 1, False)], key=str)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def removed(rows):
    """The contract's rule by a plain dictionary of windows."""
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            at = (-(1 << 63) if i is None else i, s)
            first[k] = min(first.get(k, at), at)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] != (-(1 << 63) if i is None else i, s):
                gone[s : s + 20] = [True] * 20
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup_equals_brute_force(make, prose):
    rng = random.Random(7)
    passages = [prose(rng.choice((19, 20, 21, 45, 90)), 1000 + k) for k in range(6)]
    rows = [(None, None), (3, ""), (4, "und " * 70), (5, "a b " * 40)]
    for k in range(60):
        parts = [prose(rng.randrange(40), k)]
        for _ in range(rng.randrange(4)):
            words = rng.choice(passages).split()
            if rng.random() < 0.4:
                words[rng.randrange(len(words))] = "changed"
            a = rng.randrange(10)
            parts += [" ".join(words[a:]), prose(rng.randrange(15), 5000 + k)]
        rows.append((10 + rng.randrange(10_000), "\n".join(parts)))
    rows += [(rows[9][0], rows[9][1]), (20_001, rows[8][1]), (20_001, rows[7][1] + " more"), (None, rows[6][1])]
    got = sorted((tuple(r) for r in substring_dedup.dedup_digest(make(rows)).collect()), key=str)
    assert got == removed(rows) and sum(r[2] for r in got) > 500
    kept = {r["doc_id"]: r["kept_text"] for r in substring_dedup.dedup_texts(make(rows[:20])).collect()}
    assert set(kept) == {r[0] for r in rows[:20]}


def naive_seats(votes, seats, most):
    got = [0] * len(votes)
    for _ in range(min(seats, sum(m for m, v in zip(most, votes, strict=True) if v > 0))):
        i = max((i for i in range(len(votes)) if got[i] < most[i] and votes[i] > 0), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


def test_sainte_lague_equals_highest_quotients():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 8)
        votes, most = [rng.choice((0, 1, 2, 5, 7, 100, 1000)) for _ in range(n)], [rng.randint(0, 30) for _ in range(n)]
        seats = rng.randint(0, 60)
        assert mixing.sainte_lague(votes, seats, most).tolist() == naive_seats(votes, seats, most)


def test_mix(make, spark, prose):
    docs = None
    for s, n in (("b", 200), ("a", 30), (None, 60), ("c", 5)):
        part = make([(hash((s, i)) % 100_000, prose(20 + i % 90, i)) for i in range(n)], source=s)
        docs = part if docs is None else docs.unionByName(part)
    docs = docs.unionByName(make([(7, None), (8, " ")], source="empty")).unionByName(make([(None, "x y")], source="b"))
    rows = mixing.mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert len(rows) == docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    sources, total = {}, sum(r["size"] for r in rows)
    for r in rows:
        s = sources.setdefault((r["source_size"], r["target"]), [0, 0])
        s[0] += r["size"]
        s[1] += r["taken"]
    assert abs(sum(t for _, t in sources) - 1.5 * total) < 1
    for (size, target), (mine, taken) in sources.items():
        assert size == mine and target <= 2 * size and abs(taken - target) <= 2 * mixing.BLOCK_WORDS
    assert mixing.mix(docs.limit(0)).count() == 0
    out = mixing.mixed_texts(docs)
    words = out.agg(F.sum(word_count("text"))).first()[0]
    assert words == sum(r["taken"] for r in rows) and set(out.columns) == {*docs.columns, "copy"}


def test_fill_targets():
    assert mixing.fill_targets([100, 100, 100], [3, 1, 2], 450) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.fill_targets([], [], 0) == [] and mixing.fill_targets([0], [3], 0) == [0.0]


def plain_count(word, scores, byte):
    """The best cut of all cuts: highest score, then fewest tokens."""
    text, best = "▁" + word, None
    for mask in range(1 << (len(text) - 1)):
        score, tokens, a = 0.0, 0, 0
        for b in range(1, len(text) + 1):
            if b == len(text) or mask >> (b - 1) & 1:
                piece, a = text[a:b], b
                if piece in scores:
                    score, tokens = score + scores[piece], tokens + 1
                elif len(piece) == 1:
                    n = len(piece.encode())
                    score, tokens = score + n * byte, tokens + n
                else:
                    score = -1e9
        if best is None or (round(score, 9), -tokens) > best:
            best = (round(score, 9), -tokens)
    return -best[1]


def test_trie_counts_equal_every_cut():
    scores, byte = token_counts.load_scores()
    words = ["the", "therefore", "there", "theremin", "straße", "日本", "é", "zzzzzz", "internat", "a", "x1y2"]
    assert token_counts.trie_counts(words, scores, byte) == {w: plain_count(w, scores, byte) for w in words}


def test_token_counts(make):
    docs = make([None, "", "the there the", "日本 x\n\nthe", (2, "the there the")])
    scores, byte = token_counts.load_scores()
    one = lambda w: plain_count(w, scores, byte)
    got = sorted((tuple(r) for r in token_counts.count_tokens(docs).collect()), key=str)
    three = (2, 3, 2 * one("the") + one("there"))
    assert got == sorted([(0, 0, 0), (1, 0, 0), three, (3, 3, one("日本") + one("x") + one("the")), three], key=str)


def luhn(s):
    return sum((lambda x: x * 2 - 9 * (x > 4) if i % 2 else x)(int(c)) for i, c in enumerate(reversed(s))) % 10 == 0


CASES = {
    "4111111111111111": "card", "4111 1111 1111 1111": "card", "10.0.255.7": "ip", "2024-02-29": "date", "31.12.1999": "date", "123-45-6789": "ssn", "+1 (017) 555-7713": "phone",
    "(555) 123-4567": "phone", "GB82WEST12345698765432": "iban", "jo.Doe7@mail7.example.com": "email", "5f367f08b1a810c7777ad785b0be42018bfcbf49": "hex", "5F367F08B1A810C7777AD785B0BE42018BFCBF49": "hex",
}
CLEAN = ["4111111111111112", "2023-02-30", "GB83WEST12345698765432", "256.1.1.1", "version 3, 4.0", "12345", "Im Jahr 1999 kam", "1.2.3", "a@b", "99/99/2020"]


def test_pseudonyms_keep_format_and_link(make):
    texts = [f"x {c}, y\n{c}" for c in CASES] + [f"<{c}>" for c in CASES] + CLEAN + [None, "", "straße " * 3]
    rows = {r["doc_id"]: r for r in pii.pseudonymise(make(texts), "k").collect()}
    for i, (c, kind) in enumerate(CASES.items()):
        new, again = rows[i]["text"].removeprefix("x ").split(", y\n")
        assert new == again == rows[i + len(CASES)]["text"][1:-1] != c and rows[i]["n_pii"] == 2
        if kind != "ip":
            assert [k.isdigit() for k in new] == [k.isdigit() for k in c] or kind == "hex"
            assert len(new) == len(c)
        if kind == "card":
            assert luhn(new.replace(" ", ""))
    two = [rows[i]["text"].split(",")[0].removeprefix("x ").replace(" ", "") for i in (0, 1)]
    assert two[0] == two[1]
    for i, t in enumerate(texts[2 * len(CASES) :], 2 * len(CASES)):
        assert rows[i]["text"] == t and rows[i]["n_pii"] == 0


def test_pseudonyms_are_permutations(spark, make):
    cards = [f"{i:03d}{'1' * 9}" for i in range(300)]
    cards = [next(c + d for d in "0123456789" if luhn(c + d)) for c in (x + "0" for x in cards)]
    new = [r["text"] for r in pii.pseudonymise(make(cards), "k").collect()]
    assert len(set(new)) == len(cards) and all(map(luhn, new))
    days = spark.range(0, 3000).select("id", F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    out = pii.pseudonymise(days, "k")
    assert out.select("text").distinct().count() == 3000 and out.where(F.col("text").try_cast("date").isNull()).count() == 0
    other = [r["text"] for r in pii.pseudonymise(make(cards), "another key").collect()]
    assert other != new and pii.pseudonymise(make(cards).limit(0), "k").count() == 0


def test_masks_survive_two_changes():
    width, places = decontamination.WINDOW, []
    for m in decontamination.MASKS:
        places += [{o + k for k in m} for o in range(width - decontamination.SPAN + 1)]
    for bad in itertools.combinations(range(width), 2):
        assert any(not p & set(bad) for p in places)


def test_overlaps(spark, make, prose):
    items = [prose(n, 900 + n).split() for n in (15, 20, 40)] + [["too", "short"]]
    bench = spark.createDataFrame([(i, " ".join(w), 1) for i, w in enumerate(items)] + [(9, None, 1), (10, "", 1)], "item_id bigint, text string, key int")
    rng, rows, want = random.Random(8), [], set()
    for k in range(60):
        i = k % 3
        words, left = list(items[i]), prose(rng.randrange(60), k)
        kind = k // 3 % 4
        if kind == 1:
            for at in rng.sample(range(0, len(words), 7), 2):
                words[at] = "changed"
        elif kind == 2:
            words = [w.upper() + "!!" for w in words]
        elif kind == 3:
            words = prose(len(words), 7000 + k).split()
        rows.append((k, f"{left}\n{' '.join(words)} {prose(9, 300 + k)}"))
        if kind != 3:
            want.add((k, i))
    rows += [(None, rows[0][1]), (700, None), (701, ""), rows[0]]
    found = decontamination.find_overlaps(make(rows), bench)
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert got == want | {(None, 0)} and found.count() == len(got)
    kept = decontamination.decontaminate(make(rows), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([k for k, _ in rows if k is not None and k < 100 and k // 3 % 4 == 3] + [700, 701])
    assert decontamination.find_overlaps(make(rows), bench.limit(0)).count() == 0 and decontamination.find_overlaps(make(rows).limit(0), bench).count() == 0
