"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions only.

Numbers that pass their check (Luhn, mod 97), addresses, phone numbers, secrets
and real calendar dates are replaced by a keyed permutation of the values of
the same format. A Feistel network runs over the value's digits or letters,
each position modulo its own radix, with rounds keyed by SHA-256, so a value
has one pseudonym in every document and two values never share one. Numbers
that fail their check are no personal data and stay.
"""

from __future__ import annotations

import os
import secrets
import warnings
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wickwork.llm.common import table

ROUNDS = 8
#: Where a session, or else the environment, keeps the key.
KEY_CONF, KEY_ENV = "spark.wickwork.pseudonym.key", "WICKWORK_PSEUDONYM_KEY"
#: The key of the given synthetic tables, in which nobody is named; whoever knows a key can turn pseudonyms back.
TEST_TABLES_KEY = "synthetic tables only"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
YEAR, MONTH, DAY = r"(?:18|19|20|21)\d\d", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
PATTERNS = {
    # The domain goes character by character, as Java's stack holds every repetition of a group whose length varies; a label has 63 at most.
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?!\.)(?:(?![A-Za-z0-9-]{64}|\.\.)[A-Za-z0-9.-])+(?<=\.)[A-Za-z]{2,24}",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "ip6": r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "iso_date": rf"(?<![\d/-]){YEAR}(?:-{MONTH}-{DAY}|/{MONTH}/{DAY})(?![\d/-])",
    "day_date": rf"(?<![\d./]){DAY}[./]{MONTH}[./]{YEAR}(?!\d)",
    "month_date": rf"(?<![\d./]){MONTH}/(?:1[3-9]|2\d|3[01])/{YEAR}(?!\d)",
    "bare_date": rf"(?<![\d./])(?:[1-9]|[12]\d|3[01])\.(?:[1-9]|1[0-2])\.{YEAR}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-])",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}([ -])(?:\d{4}\1\d{4}\1\d{1,7}|\d{6}\1\d{5}))(?!\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])",
}
#: Days of a Gregorian cycle of 400 years, as two radices.
CYCLE_START, RADICES = "1800-01-01", (189, 773)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def feistel(values: Column, radices: Column, key: str, kind: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of arrays of ints below `radices`, position by position."""

    def turn(acc: Column, i: Column, r: Column) -> Column:
        even, n = i % 2 == 0, F.size(acc)
        h = F.floor(n / 2).cast("int")
        half = F.when(even, F.slice(acc, h + 1, n - h)).otherwise(F.slice(acc, F.lit(1), h))
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), n.cast("string"), F.array_join(half.cast("array<string>"), ",")), 256)
        round_ = F.struct(digest.alias("d"), h.alias("h"), even.alias("e"))

        def add(x: Column, p: Column, s: Column) -> Column:
            return F.when((p < s["h"]) == s["e"], F.pmod(x + F.pmod(F.xxhash64(s["d"], p), r[p].cast("bigint")), r[p].cast("bigint")).cast("int")).otherwise(x)

        return let(round_, lambda s: F.transform(acc, lambda x, p: add(x, p, s)))

    both = F.struct(values.alias("v"), radices.alias("r"))
    return let(both, lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x["v"], lambda acc, i: turn(acc, i, x["r"])))


def _chars(text: Column) -> Column:
    return F.split(text, "")


def _is_digit(c: Column) -> Column:
    return c.between("0", "9")


def _is_upper(c: Column) -> Column:
    return c.between("A", "Z")


def _is_alnum(c: Column) -> Column:
    return _is_digit(c) | _is_upper(c) | c.between("a", "z")


def _digits(text: Column) -> Column:
    """The digits of a text as ints."""
    return F.transform(F.filter(_chars(text), _is_digit), lambda c: c.cast("int"))


def _refill(shape: Column, core: Column, kept: Callable[[Column], Column]) -> Column:
    """Put the characters of `core` at the places of `shape` whose characters are `kept`."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def put(acc: Column, c: Column, new: Column) -> Column:
        return F.struct(F.concat(acc["out"], F.when(kept(c), F.get(new, acc["k"])).otherwise(c)).alias("out"), (acc["k"] + F.when(kept(c), 1).otherwise(0)).alias("k"))

    return let(core, lambda new: F.aggregate(_chars(shape), start, lambda acc, c: put(acc, c, new), lambda acc: acc["out"]))


def _tens(values: Column) -> Column:
    return F.array_repeat(F.lit(10), F.size(values))


def _permute_digits(text: Column, key: str, kind: str) -> Column:
    """Digits permuted among themselves; all else stays in its place."""
    new = let(_digits(text), lambda v: feistel(v, _tens(v), key, kind))
    return _refill(text, new.cast("array<string>"), _is_digit)


def _permute_alnum(text: Column, key: str, kind: str) -> Column:
    """Digits stay digits and letters letters of their case; ASCII only."""
    value = lambda c: F.when(_is_digit(c), F.ascii(c) - 48).otherwise(F.ascii(F.lower(c)) - 97)
    radix = lambda c: F.when(_is_digit(c), 10).otherwise(26)
    render = lambda v, c: F.char(v + F.when(_is_digit(c), 48).when(_is_upper(c), 65).otherwise(97))
    new = let(F.filter(_chars(text), _is_alnum), lambda core: F.zip_with(feistel(F.transform(core, value), F.transform(core, radix), key, kind), core, render))
    return _refill(text, new, _is_alnum)


def _permute_hex(text: Column, key: str, kind: str = "secret") -> Column:
    values = F.transform(_chars(text), lambda c: F.conv(c, 16, 10).cast("int"))
    new = let(values, lambda v: feistel(v, F.array_repeat(F.lit(16), F.size(v)), key, kind))
    return let(F.array_join(F.transform(new, lambda v: F.hex(v)), ""), lambda x: F.when(text.rlike("[a-f]") | ~text.rlike("[A-F]"), F.lower(x)).otherwise(x))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of an array of digits (ints), the last being the check digit."""
    doubled = F.transform(F.reverse(digits), lambda x, i: F.when(i % 2 == 1, 2 * x - F.when(x > 4, 9).otherwise(0)).otherwise(x))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _card(text: Column, key: str) -> Column:
    def check(body: Column) -> Column:
        return (10 - luhn_sum(F.concat(body, F.array(F.lit(0)))) % 10) % 10

    def new(digits: Column) -> Column:
        body = let(F.slice(digits, F.lit(1), F.size(digits) - 1), lambda v: feistel(v, _tens(v), key, "card"))
        return F.when(luhn_sum(digits) % 10 == 0, let(body, lambda v: F.concat(v, F.array(check(v)))))

    return let(let(_digits(text), new), lambda v: F.when(v.isNotNull(), _refill(text, v.cast("array<string>"), _is_digit)))


def _mod97(text: Column) -> Column:
    """Remainder of an IBAN's letters and digits read as one number."""
    moved = F.concat(F.substring(text, 5, 40), F.substring(text, 1, 4))
    step = lambda a, c: F.when(_is_digit(c), (a * 10 + (F.ascii(c) - 48)) % 97).otherwise((a * 100 + (F.ascii(c) - 55)) % 97)
    return F.aggregate(_chars(moved), F.lit(0), step)


def _iban(text: Column, key: str) -> Column:
    country = F.substring(text, 1, 2)

    def join(body: Column) -> Column:
        check = 98 - _mod97(F.concat(country, F.lit("00"), body))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), body)

    return F.when(_mod97(text) == 1, let(_permute_alnum(F.substring(text, 5, 40), key, "iban"), join))


def _grouped_iban(text: Column, key: str) -> Column:
    """An IBAN whose characters may stand in groups: it has the pseudonym that it has without the blanks."""
    return let(_iban(F.replace(text, F.lit(" "), F.lit("")), key), lambda v: F.when(v.isNotNull(), _refill(text, _chars(v), _is_alnum)))


def _ip6(text: Column, key: str) -> Column:
    """The digits are permuted in their places, so an address that is written in another way has another pseudonym."""
    is_hex = lambda c: c != ":"
    return let(_permute_hex(F.replace(text, F.lit(":"), F.lit("")), key, "ip6"), lambda v: _refill(text, _chars(v), is_hex))


def _date(day: Column, key: str) -> Column:
    start = F.lit(CYCLE_START).cast("date")
    halves = let(F.datediff(day, start), lambda n: F.array(F.floor(n / RADICES[1]).cast("int"), (n % RADICES[1]).cast("int")))
    return let(feistel(halves, F.array(*map(F.lit, RADICES)), key, "date"), lambda x: F.date_add(start, x[0] * RADICES[1] + x[1]))


@cache
def drawn_key(application: str) -> str:
    """256 random bits for each application of this driver."""
    return secrets.token_hex(32)


def session_key(spark: SparkSession) -> str:
    """The session's key (KEY_CONF, then KEY_ENV).

    Where neither is set that of the synthetic tables, which protects nothing,
    but only under a local master: on a cluster a key is drawn, one for the
    whole application. Pseudonyms under it agree with each other, but with
    those of no other run, and nobody who reads this source can turn them back.
    """
    if key := spark.conf.get(KEY_CONF, None) or os.environ.get(KEY_ENV):
        return key
    if spark.sparkContext.master.startswith("local"):
        return TEST_TABLES_KEY
    warnings.warn(f"neither {KEY_CONF} nor {KEY_ENV} is set: pseudonyms under a key drawn for this application agree with those of no other run", stacklevel=2)
    return drawn_key(spark.sparkContext.applicationId)


def _email(text: Column, at: Column, key: str) -> Column:
    """Name and domain are permuted apart, so that addresses of one domain stay together; the last label stays."""
    domain = F.substring(text, at + 1, F.length(text))
    top = F.substring_index(domain, ".", -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    return F.concat(_permute_alnum(F.substring(text, F.lit(1), at - 1), key, "email"), F.lit("@"), _permute_alnum(host, key, "domain"), top)


def pseudonym(found: Column, key: str) -> Column:
    """The pseudonym of one match of PATTERNS; null if it fails its check."""
    at = F.instr(found, "@")
    iso, dot = F.translate(found, "/", "-").try_cast("date"), F.substring(found, 3, 1)
    american = F.concat_ws("-", F.substring(found, 7, 4), F.substring(found, 1, 2), F.substring(found, 4, 2)).try_cast("date")
    bare = F.concat_ws("-", F.reverse(F.split(found, r"\."))).try_cast("date")
    day = F.concat_ws("-", F.substring(found, 7, 4), F.substring(found, 4, 2), F.substring(found, 1, 2)).try_cast("date")
    octets = F.transform(F.split(found, r"\."), lambda x: x.cast("int"))
    country = F.regexp_extract(found, r"^(\+\d{1,3}[ .-](?=\(?\d)|\+\d)?", 0)
    whole = lambda kind: found.rlike(f"^(?:{PATTERNS[kind]})$")
    return (
        F.when(at > 0, _email(found, at, key))
        .when(whole("ip"), F.array_join(feistel(octets, F.array_repeat(F.lit(256), 4), key, "ip").cast("array<string>"), "."))
        .when(whole("ip6"), _ip6(found, key))
        .when(whole("iso_date"), F.replace(F.date_format(_date(iso, key), "yyyy-MM-dd"), F.lit("-"), F.substring(found, 5, 1)))
        .when(whole("day_date"), F.replace(F.date_format(_date(day, key), "dd-MM-yyyy"), F.lit("-"), dot))
        .when(whole("month_date"), F.date_format(_date(american, key), "MM/dd/yyyy"))
        .when(whole("bare_date"), F.date_format(_date(bare, key), "d.M.yyyy"))
        .when(whole("ssn"), _permute_digits(found, key, "ssn"))
        .when(whole("phone"), F.concat(country, _permute_digits(F.substring(found, F.length(country) + 1, F.length(found)), key, "phone")))
        .when(whole("card") & ~found.rlike("[a-fA-F]"), F.coalesce(_card(found, key), F.when(whole("secret"), _permute_hex(found, key))))
        .when(whole("iban"), _grouped_iban(found, key))
        .when(whole("secret"), _permute_hex(found, key))
    )


def pseudonymise(docs: DataFrame, key: str, counted: str = "n_pii") -> DataFrame:
    """The columns of `docs` with text replaced, and the number of values replaced in the column `counted`.

    Null and empty texts stay as they are with 0 replaced. Every other column,
    n_chars too, is left alone; `counted` must be no column of `docs`. Rows are
    independent, so repeated rows stay equal.
    """
    if counted.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {counted}; name another one for the count")
    pattern = "|".join(PATTERNS.values())
    # Of the groups only the card's separator is numbered; its reference holds in the joined pattern.
    text = F.col("__text")
    may = F.coalesce(text.rlike(r"[0-9@]|[a-fA-F]{32}"), F.lit(False))
    found = F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    # The row is kept in one column, so that no name of it can clash.
    inside = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__d"), F.col("text").cast("string").alias("__text"))
    named = inside.withColumn("__found", found).withColumn("__new", F.transform("__found", lambda m: pseudonym(m, key)))
    filled = F.zip_with("__new", "__found", lambda n, m: F.coalesce(n, m))
    joined = F.array_join(F.zip_with(F.split(text, pattern, -1), F.concat(filled, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    count = F.size(F.filter("__new", lambda x: x.isNotNull()))
    new = F.when(F.exists("__new", lambda x: x.isNotNull()), joined).otherwise(text)
    return named.select(*[(new if c == "text" else F.col(f"__d.`{c}`")).alias(c) for c in docs.columns], count.alias(counted))


def op4_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, session_key(spark))
