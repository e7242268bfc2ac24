"""Pseudonyms against a Feistel network written out in plain Python."""

import datetime
import hashlib

import pytest
import xxhash

import corpus_pipeline
from wickwork.llm import pii

KEY = "tests"


def network(values, radices, kind):
    values = list(values)
    n = len(values)
    h = n // 2
    for i in range(1, pii.ROUNDS + 1):
        half = values[h:] if i % 2 == 0 else values[:h]
        digest = hashlib.sha256("|".join([KEY, kind, str(i), str(n), ",".join(map(str, half))]).encode()).hexdigest()
        seed = xxhash.xxh64_intdigest(digest.encode(), 42)
        for p in range(n):
            if (p < h) == (i % 2 == 0):
                x = xxhash.xxh64_intdigest(p.to_bytes(4, "little"), seed)
                values[p] = (values[p] + (x - (1 << 64) if x >> 63 else x)) % radices[p]
    return values


def digits(text, kind):
    new = iter(network([int(c) for c in text if c.isdigit()], [10] * sum(c.isdigit() for c in text), kind))
    return "".join(str(next(new)) if c.isdigit() else c for c in text)


def alnum(text, kind):
    core = [c for c in text if c.isalnum()]
    new = iter(network([int(c) if c.isdigit() else ord(c.lower()) - 97 for c in core], [10 if c.isdigit() else 26 for c in core], kind))
    return "".join((str if c.isdigit() else lambda v, c=c: chr(v + (65 if c.isupper() else 97)))(next(new)) if c.isalnum() else c for c in text)


def luhn(body):
    return str(-sum((d * 2 - 9 * (d > 4)) if i % 2 == 0 else d for i, d in enumerate(map(int, reversed(body)))) % 10)


def number(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4]))


def date(text):
    days = (datetime.date.fromisoformat(text) - datetime.date(1800, 1, 1)).days
    a, b = network(divmod(days, pii.RADICES[1]), pii.RADICES, "date")
    return (datetime.date(1800, 1, 1) + datetime.timedelta(a * pii.RADICES[1] + b)).isoformat()


def card(text):
    body = "".join(map(str, network([int(c) for c in text[:-1]], [10] * (len(text) - 1), "card")))
    return body + luhn(body)


def iban(text):
    body = alnum(text[4:], "iban")
    return f"{text[:2]}{98 - number(text[:2] + '00' + body) % 97:02d}{body}"


WANT = {
    "4111111111111111": card, "5500005555555559": card, "2024-02-29": date, "1800-01-01": date, "123-45-6789": lambda t: digits(t, "ssn"),
    "GB82WEST12345698765432": iban, "DE89370400440532013000": iban, "10.0.255.7": lambda t: ".".join(map(str, network(map(int, t.split(".")), [256] * 4, "ip"))),
    "jo.Doe7@mail7.example.com": lambda t: f"{alnum('jo.Doe7', 'email')}@{alnum('mail7.example.', 'domain')}com", "(555) 123-4567": lambda t: digits(t, "phone"),
    "5f367f08b1a810c7777ad785b0be42018bfcbf49": lambda t: "".join(f"{x:x}" for x in network([int(c, 16) for c in t], [16] * len(t), "secret")),
}


def test_pseudonyms_equal_the_network(make):
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(make([f"see {t}." for t in WANT]), KEY).collect()}
    assert got == {i: f"see {f(t)}." for i, (t, f) in enumerate(WANT.items())}
    assert all(number(iban(t)) % 97 == 1 for t in WANT if t[0] in "GD")


def test_count_has_a_name_of_its_own(make, spark):
    docs = spark.createDataFrame([(1, "call (555) 123-4567", 5, "x", 9)], "doc_id bigint, text string, n_pii int, `a.b` string, __new int")
    with pytest.raises(ValueError):
        pii.pseudonymise(docs, KEY)
    (row,) = pii.pseudonymise(docs, KEY, "replaced").collect()
    assert row.asDict() == {"doc_id": 1, "text": f"call {digits('(555) 123-4567', 'phone')}", "n_pii": 5, "a.b": "x", "__new": 9, "replaced": 1}


def test_key_of_the_session(spark):
    assert pii.session_key(spark) == pii.TEST_TABLES_KEY
    spark.conf.set(pii.KEY_CONF, "own")
    try:
        assert pii.session_key(spark) == "own"
    finally:
        spark.conf.unset(pii.KEY_CONF)


def test_a_cluster_without_a_key_draws_one(make, spark, tmp_path, monkeypatch):
    monkeypatch.delenv(pii.KEY_ENV, raising=False)
    make(["mail jo@a.com", "or jo@a.com"], clash=False).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.warns(UserWarning, match=pii.KEY_ENV):
        key = pii.session_key(spark)
    assert key not in ("", pii.TEST_TABLES_KEY) and len(key) == 64 and pii.drawn_key("another") != key
    with pytest.warns(UserWarning):
        got = {r["doc_id"]: r["text"] for r in pii.op4_pii(spark, str(tmp_path)).collect()}
    # Stage and query of one application agree.
    with pytest.warns(UserWarning):
        stage = corpus_pipeline.personal_data(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    assert {r["doc_id"]: r["text"] for r in stage.collect()} == got and got[0].split()[1] == got[1].split()[1]


def test_domains_of_any_number_of_labels(make):
    texts = ["see jo@" + "b." * 20_000 + "com", "see jo@" + "b." * 20_000 + "1", "see jo@a.bb..c", "see jo@a." + "c" * 70, "see jo@.a.com", "see jo@a.b.1.cc.1"]
    got = [(r["text"], r["n_pii"]) for r in pii.pseudonymise(make(texts), KEY).orderBy("doc_id").collect()]
    assert [n for _, n in got] == [1, 0, 1, 1, 0, 1]
    assert got[0][0].startswith(f"see {alnum('jo', 'email')}@") and got[0][0].endswith(".com") and len(got[0][0]) == len(texts[0]) and got[1][0] == texts[1]
    # The domain ends after its last label that letters follow, and the last label takes 24 of them.
    assert got[2][0].endswith("@" + alnum("a.", "domain") + "bb..c") and got[3][0].endswith(alnum("a.", "domain") + "c" * 70) and got[5][0].endswith(alnum("a.b.1.", "domain") + "cc.1")


def spaced(shape, core):
    new = iter(core)
    return "".join(next(new) if c.isalnum() else c for c in shape)


def hexes(text):
    core = text.replace(":", "")
    return spaced(text, "".join(f"{x:x}" for x in network([int(c, 16) for c in core], [16] * len(core), "ip6")))


def parts(text, order, sep):
    y, m, d = date("-".join(f"{int(p):02d}" for p in (text.split(sep)[i] for i in order))).split("-")
    return {"y": y, "m": m, "d": d}


FORMS = {
    "DE89 3704 0044 0532 0130 00": lambda t: spaced(t, iban(t.replace(" ", ""))), "3782 822463 10005": lambda t: spaced(t, card(t.replace(" ", ""))),
    "378282246310005": card, "12/25/2023": lambda t: "{m}/{d}/{y}".format(**parts(t, (2, 0, 1), "/")), "2023/12/25": lambda t: "{y}/{m}/{d}".format(**parts(t, (0, 1, 2), "/")),
    "1.2.2023": lambda t: ".".join(str(int(parts(t, (2, 1, 0), ".")[k])) for k in "dm") + "." + parts(t, (2, 1, 0), ".")["y"],
    "555-123-4567": lambda t: digits(t, "phone"), "2001:db8:85a3:0:0:8a2e:370:7334": hexes, "fe80::1ff:fe23:4567:890a": hexes,
}


def test_common_forms(make):
    got = {r["doc_id"]: (r["text"], r["n_pii"]) for r in pii.pseudonymise(make([f"see {t}, or ({t})" for t in FORMS]), KEY).collect()}
    assert got == {i: (f"see {f(t)}, or ({f(t)})", 2) for i, (t, f) in enumerate(FORMS.items())}
    # The same value has the same pseudonym in every form.
    assert FORMS["DE89 3704 0044 0532 0130 00"]("DE89 3704 0044 0532 0130 00").replace(" ", "") == iban("DE89370400440532013000")


def test_what_fails_its_check_stays(make):
    stays = ["DE88 3704 0044 0532 0130 00", "3782 822463 10006", "13/32/2023", "2023/13/25", "31.2.2023", "1.13.2023", "5555-123-4567", "555-123-45678", "12:30:45", "a::b::c", "1.2.2023.4"]
    got = [(r["text"], r["n_pii"]) for r in pii.pseudonymise(make([f"see {t} there" for t in stays]), KEY).orderBy("doc_id").collect()]
    assert got == [(f"see {t} there", 0) for t in stays]


def test_a_very_long_text(make):
    text = "word " * 60_000 + "4111111111111111 " + "word " * 60_000
    (row,) = pii.pseudonymise(make([text]), KEY).collect()
    assert row["text"] == text.replace("4111111111111111", card("4111111111111111")) and row["n_pii"] == 1
