"""Language identification by compression with per-language zstandard dictionaries.

A language's dictionary is raw content: the terms that make up most of its
labelled texts, counted over all of them. A text is cut into pieces of at most PIECE bytes (all of them
count), each piece is compressed once per dictionary, and the language with
the smallest sum wins. A text that is shorter than SHORT bytes is written TIMES
times, as zstandard stores what it can hardly shorten as it is, whichever the
dictionary. Narrow margins are rejected: the runner-up has to be larger by a
share that all but LOSS of the right predictions reach on a fold of labelled
rows, all of it, under dictionaries that have not seen the fold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickwork.llm.common import crc_mod, held_out, table

FOLDS, HELD, CALIBRATE = 5, 0, 1
#: A term: a word and the white space after it, or such a slice of a longer word. Every character is in one term.
TERM = r"\S{1,16}\s?"
#: The size of a dictionary: at most this many terms and characters.
TERMS, CHARS = 8192, 67_200
PIECE, LEVEL, SHORT, TIMES = 8192, 6, 128, 4
#: The margin: the share of right predictions that may fall below it, and its steps.
LOSS, STEPS = 0.002, 10_000
LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    """Dictionaries by language, the commonest first, and the share by which the runner-up has to be larger."""

    dictionaries: dict[str, bytes] = field(default_factory=dict)
    margin: float = 0.0


def _labelled(rows: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return rows.select("doc_id", F.col("lang").cast("string").alias("lang"), text.alias("text")).where(F.col("lang").isNotNull() & text.rlike(r"\p{L}"))


def dictionaries(rows: DataFrame, apart: Column | None = None, terms: int = TERMS, chars: int = CHARS) -> tuple[dict[str, bytes], dict[str, bytes]]:
    """Dictionaries by language from rows (doc_id, lang, text): those of all rows, and those without the rows `apart`.

    Every term of every row counts. A dictionary takes the terms that cover
    most characters, in this order.
    """
    apart = F.lit(False) if apart is None else apart
    # One row per language.
    texts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    each = rows.select("lang", apart.alias("apart"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))).alias("term"))
    counted = each.groupBy("lang", "term").agg(F.count("*").alias("n"), F.count(F.when(~F.col("apart"), True)).alias("seen"))
    uses = F.array(F.struct(F.lit(True).alias("whole"), F.col("n").alias("n")), F.struct(F.lit(False).alias("whole"), F.col("seen").alias("n")))
    sized = counted.select("lang", "term", F.explode(uses).alias("x")).select("lang", "term", "x.whole", (F.col("x.n") * F.length("term")).alias("size")).where("size > 0")
    best = Window.partitionBy("lang", "whole").orderBy(F.desc("size"), "term")
    # Each task leaves its best `terms` of a language first, so no task gets all terms of one.
    taken = sized.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= terms)
    taken = taken.withColumn("chars", F.sum(F.length("term")).over(best.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("chars") <= chars).collect()
    found: tuple[dict[str, list], dict[str, list]] = ({}, {})
    for r in sorted(taken, key=lambda r: (-texts[r["lang"]], r["lang"], r["nth"])):
        found[0 if r["whole"] else 1].setdefault(r["lang"], []).append(r["term"])
    return tuple({k: "".join(v).encode() for k, v in x.items()} for x in found)


def least_margin(gaps: DataFrame, loss: float) -> float:
    """The largest multiple of 1 / STEPS, 1 at most, that no more than a share `loss` of the rows' gaps lie below; 0 without rows."""
    step = F.least(F.floor(F.col("gap") * STEPS), F.lit(STEPS)).alias("step")
    counts = sorted((r["step"], r["n"]) for r in gaps.groupBy(step).agg(F.count("*").alias("n")).collect())
    below, total = 0, sum(n for _, n in counts)
    for at, n in counts:
        below += n
        if below > loss * total:
            return at / STEPS
    return 0.0


def learn(labelled: DataFrame, loss: float = LOSS) -> Model:
    """The model from rows (doc_id, text, lang); rows without a text or a language teach nothing.

    All rows make the dictionaries. One fold of them, every row of it, sets the
    margin under dictionaries that the other rows make. Without a right
    prediction in that fold only ties are rejected.
    """
    known = _labelled(labelled)
    apart = F.coalesce(crc_mod("doc_id", FOLDS) == CALIBRATE, F.lit(False))
    made, unseen = dictionaries(known, apart)
    tested = known.where(apart).select("lang", "text").mapInArrow(_classifier(Model(unseen)), f"lang string, {_FOUND}")
    # Right predictions that are no ties.
    return Model(made, least_margin(tested.where("lang = lang_pred and gap > 0"), loss))


def _compressors(models: dict[str, bytes]) -> list:
    made = []
    for lang in models:
        d = zstandard.ZstdCompressionDict(models[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        made.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)))
    return made


def classify(text: str | None, compressors: list) -> tuple[str, float, float]:
    """(language, score, gap) of a whole text; gap is the share by which the runner-up is larger."""
    if text is None or not compressors or not LETTER.search(text):
        return "und", 0.0, 0.0
    data = text.lower().encode("utf-8", "replace")
    if len(data) < SHORT:
        data = (data + b" ") * TIMES
    sizes = [(sum(len(c.compress(data[i : i + PIECE])) for i in range(0, len(data), PIECE)), lang) for lang, c in compressors]
    sizes.sort(key=lambda x: x[0])  # of equal sizes the commoner language
    best, lang = sizes[0]
    if len(sizes) == 1:
        return lang, 1.0, 1.0
    score = 1 / (1 + sum(math.exp((best - s) / 3) for s, _ in sizes[1:]))
    return lang, score, (sizes[1][0] - best) / best


_NAMES = ["lang_pred", "score", "gap", "rejected"]
_FOUND = "lang_pred string, score double, gap double, rejected boolean"


def _columns(texts: pa.Array, compressors: list, margin: float) -> list[pa.Array]:
    """The columns _FOUND of an Arrow column of texts."""
    found = [classify(t.as_py(), compressors) for t in texts]
    lang, score, gap = zip(*found, strict=True) if found else ((), (), ())
    rejected = [g <= 0 or g < margin for g in gap]
    return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(gap, pa.float64()), pa.array(rejected, pa.bool_())]


def _classifier(model: Model):
    """Puts what is found in the place of the last column, the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(model.dictionaries)
        for batch in batches:
            columns = _columns(batch.column(batch.num_columns - 1), compressors, model.margin)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], *_NAMES])

    return run


def _found(model: Model):
    """What is found of a text as a struct: rows stay where they are, their texts alone go to Python, and once."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compressors = _compressors(model.dictionaries)
        for texts in batches:
            yield pa.StructArray.from_arrays(_columns(texts, compressors, model.margin), _NAMES)

    # Else the filter is pushed below and each text is classified once for it and once more for the columns.
    return F.arrow_udf(run, _FOUND).asNondeterministic()


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, gap, rejected: one row per row of `docs` (doc_id, text).

    Text that is null or without a letter is `und`, score and gap 0, rejected.
    Both are 1 for a sole language. Long texts are read whole, piece by piece.
    Repeated rows get equal rows; other columns are ignored.
    """
    rows = docs.select("doc_id", F.col("text").cast("string"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_classifier(model), f"doc_id {kind}, {_FOUND}")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, all columns, whose language is not rejected; a null lang becomes the prediction."""
    names = docs.columns
    # The row stands in a column of its own, so that none of its names can clash.
    inside = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("d"))
    seen = inside.withColumn("found", _found(model)(F.col("d.text").cast("string"))).where("not found.rejected")
    lang = F.coalesce("d.lang", "found.lang_pred")
    return seen.select(*[(lang if c == "lang" else F.col(f"d.`{c}`")).alias(c) for c in names])


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = held_out("doc_id", FOLDS, HELD)
    model = learn(docs.where(~held & F.col("doc_id").isNotNull()))
    found = identify(docs, model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "gap", "rejected")
