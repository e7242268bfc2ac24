"""Shared helpers: tables, words, slices of Arrow batches, written intermediate tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wickwork.sources.scratch import cut, shared_dir

#: Characters between words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
GAPS = r"[\x20\x09-\x0D]+"


#: Bits of the largest filter of keys (8 MB).
FILTER_BITS = 26

__all__ = ["FILTER_BITS", "GAPS", "WORD", "crc_mod", "cut", "filter_bits", "held_out", "may_hold", "shared_dir", "table", "text_slices", "word_count"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: Column | str, n: int) -> Column:
    """crc32 of the id written as text, modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % n


def held_out(column: str, n: int, rest: int) -> Column:
    """True where crc32(id as text) mod n is rest; a null id is never held out nor learned from."""
    return F.coalesce(crc_mod(column, n) == rest, F.lit(False))


def word_count(text: str = "text") -> Column:
    """Words of a text as a bigint; 0 for null."""
    words = F.size(F.split(F.regexp_replace(F.col(text), f"^{GAPS}|{GAPS}$", ""), GAPS))
    return F.when(F.col(text).rlike(r"[^\x20\x09-\x0D]"), words).otherwise(0).cast("bigint")


def text_slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, list]]:
    """(first row, UTF-8 texts) of runs of an Arrow column that hold about `limit` bytes each, so that few words are held at once."""
    texts = column.cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes.tolist()):
        held += n
        if held >= limit:
            yield start, texts.slice(start, i + 1 - start).to_pylist()
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, texts.slice(start).to_pylist()


def filter_bits(keys: DataFrame) -> np.ndarray:
    """A bit for each of the keys (one long column of evenly spread hashes), modulo the filter's size, as 64-bit words.

    About 16 bits a key, FILTER_BITS at most: it spares rows from an exact join
    and lets more of them through where it is full.
    """
    (name,) = keys.columns
    bits = min(FILTER_BITS, max(16, (16 * keys.count()).bit_length()))
    at = F.col(name).bitwiseAND(F.lit((1 << bits) - 1))
    bit = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)).cast("int")))
    rows = keys.groupBy(F.shiftright(at, 6).alias("word")).agg(bit.alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return words


def may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be one of the filter's; no key of the filter is ever denied."""
    at = keys.view(np.uint64) & np.uint64(len(words) * 64 - 1)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
