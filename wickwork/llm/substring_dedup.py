"""Substring dedup by relative Lempel-Ziv parsing against blocks of the whole corpus.

Reference blocks are cut by content: the anchor of a window of WINDOW words is
its smallest hashed run of GRAM words, and neighbouring windows with one anchor
make a block, so equal passages are cut alike wherever they stand. All blocks
are indexed by anchor and content, each content with its first place.

A document is parsed from left to right. Where a block's content stands
earlier, a factor (place, words, reference, place in the reference) begins, and
it goes on over the next blocks as long as their first places follow each other
in one reference. It ends where a block stands still earlier elsewhere, so it
need not be the longest match over all places (README tells why); what factors
cover does not depend on that. A factor can also begin and end inside a block.
Such a block shares its anchor with a block of other content, so there, at the
factor boundaries, the windows are indexed and looked up one by one, which
carries factors on, word by word, to where their reference ends. Factors are of
WINDOW words at least; every window that stands earlier lies in one, and the
words that factors cover are removed.

A third of all rows may hold one passage: blocks and windows are counted with
partial aggregation and joined to one row per key, which adaptive execution
splits; no group is gathered but the factors of one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickwork.llm.common import cut, table, text_slices

WINDOW, GRAM, SEED = 20, 8, 3
#: An odd multiplier of polynomial hashes modulo 2^64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: A place packs the start and the number of windows; null ids come first.
COUNT_BITS, NULL_ID = 4, -(1 << 63)
#: Words a task remembers the hashes of, and the bits of the largest filter of shared anchors (8 MB).
REMEMBER, FILTER_BITS = 200_000, 26


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n + 1, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Corpus:
    """The words of some texts in a row, hashed; hashes of any stretch in constant time."""

    def __init__(self, texts: list[bytes | None], seen: dict[bytes, int]):
        if len(seen) > REMEMBER:
            seen.clear()
        self.words = [t.split() if t else [] for t in texts]
        for w in set().union(*self.words).difference(seen):
            h = xxhash.xxh64_intdigest(w, SEED)
            seen[w] = h - (1 << 64) if h >> 63 else h
        sizes = [len(w) for w in self.words]
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        n = int(self.starts[-1])
        hashes = np.fromiter((seen[w] for ws in self.words for w in ws), np.int64, n).view(np.uint64)
        self.down = _powers(n, INVERSE)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(n, BASE)[:n], dtype=np.uint64)])
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.n = n

    def stretch(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.down[start])

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor hash, first window, number of windows) of each block, in order."""
        last = self.n - WINDOW + 1
        empty = np.zeros(0, np.int64)
        if last <= 0:
            return empty.view(np.uint64), empty, empty
        start = np.arange(self.n - GRAM + 1)
        low = self.stretch(start, start + GRAM)
        at, width, want = start, 1, WINDOW - GRAM + 1
        while width < want:
            step = min(width, want - width)
            a, b = low[:-step], low[step:]
            later = b <= a
            low, at, width = np.where(later, b, a), np.where(later, at[step:], at[:-step]), width + step
        valid = self.doc[:last] == self.doc[WINDOW - 1 :]
        window = np.flatnonzero(valid)
        if not len(window):
            return empty.view(np.uint64), empty, empty
        anchor = at[window]
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (self.doc[window[1:]] != self.doc[window[:-1]])]))
        return low[window[first]], window[first], np.diff(np.append(first, len(window)))


def _slices(batch: pa.RecordBatch, column: int, seen: dict):
    for a, texts in text_slices(batch.column(column)):
        yield a, texts, _Corpus(texts, seen)


def _entries(batch: pa.RecordBatch, a: int, corpus: _Corpus, anchor, content, start, count) -> pa.RecordBatch:
    """Rows (anchor, content, id, key, place) of stretches of a slice that begins at row a of the batch (id, key, ...)."""
    doc = corpus.doc[start]
    row = pa.array(doc + a, pa.int64())
    place = (start - corpus.starts[doc]) << COUNT_BITS | count
    return pa.RecordBatch.from_arrays(
        [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), pa.array(place, pa.int64())], ["anchor", "content", "id", "key", "place"]
    )


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict = {}
    for batch in batches:
        for _, _, corpus in _slices(batch, 2, seen):
            yield pa.RecordBatch.from_arrays([pa.array(corpus.blocks()[0].view(np.int64))], ["anchor"])


def _blocks(bits):
    """Blocks whose anchor may be shared: those that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        words, mask = bits.value, np.uint64(len(bits.value) * 64 - 1)
        for batch in batches:
            for a, _, corpus in _slices(batch, 2, seen):
                anchor, start, count = corpus.blocks()
                at = anchor & mask
                use = (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
                anchor, start, count = anchor[use], start[use], count[use]
                yield _entries(batch, a, corpus, anchor, corpus.stretch(start, start + count + WINDOW - 1), start, count)

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the listed blocks."""
    seen: dict = {}
    for batch in batches:
        lists = batch.column(3).to_pylist()
        for a, texts, corpus in _slices(batch, 2, seen):
            anchor, start, count = corpus.blocks()
            doc = corpus.doc[start]
            place = (start - corpus.starts[doc]) << COUNT_BITS | count
            use = np.zeros(len(start), bool)
            bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
            for d in range(len(texts)):
                s = slice(bounds[d], bounds[d + 1])
                use[s] = np.isin(place[s], np.array(lists[a + d], np.int64))
            anchor, start, count = anchor[use], start[use], count[use]
            which = np.repeat(np.arange(len(start)), count)
            first = start[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            yield _entries(batch, a, corpus, anchor[which], corpus.stretch(first, first + WINDOW), first, np.ones(len(first), np.int64))


def parse(found: list | None) -> list[tuple[int, int, int, int]]:
    """Factors (start, n_words, ref_id, ref_start) of one text, from left to right, from what stands earlier of it.

    `found` has (place, ref_id, ref_start) of blocks and windows, each once. A
    factor takes all that follows as long as text and reference both go on
    without a gap; the next one begins with the first window that it lacks, so
    factors overlap by WINDOW - 1 words where one window takes up another reference.
    """
    out: list[tuple[int, int, int, int]] = []
    start = windows = ref = at = None
    for place, ref_id, ref_start in sorted(found or ()):
        s, n = place >> COUNT_BITS, place & ((1 << COUNT_BITS) - 1)
        if start is not None and s == start + windows and ref_id == ref and ref_start == at + windows:
            windows += n
            continue
        if start is not None:
            out.append((start, windows + WINDOW - 1, ref, at))
        start, windows, ref, at = s, n, ref_id, ref_start
    if start is not None:
        out.append((start, windows + WINDOW - 1, ref, at))
    return out


def removed_words(text: bytes | None, found: list | None) -> tuple[list[bytes], np.ndarray]:
    """The words of a text and which of them its factors cover."""
    words = text.split() if text else []
    edge = np.zeros(len(words) + 1, np.int64)
    for start, n, _, _ in parse(found):
        edge[start] += 1
        edge[start + n] -= 1
    return words, np.cumsum(edge)[:-1] > 0


def _found(batch: pa.RecordBatch) -> Iterator[list]:
    """The lists (place, ref_id, ref_start) of each row of a batch (id, text, found)."""
    column = batch.column(2)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy()
    flat = list(zip(*(f.to_pylist() for f in column.values.flatten()), strict=True))
    for i, valid in enumerate(column.is_valid().to_pylist()):
        yield flat[ends[i] : ends[i + 1]] if valid else []


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, gone, digest = [], [], []
        for text, found in zip(batch.column(1).cast(pa.binary()).to_pylist(), _found(batch), strict=True):
            words, out = removed_words(text, found)
            if out.any():
                words = [words[i] for i in np.flatnonzero(~out).tolist()]
            n.append(len(out))
            gone.append(int(out.sum()))
            digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], ["id", "n_words", "n_removed", "kept_sha256"])


def _kept_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for text, found in zip(batch.column(1).cast(pa.binary()).to_pylist(), _found(batch), strict=True):
            words, out = removed_words(text, found)
            kept.append(b" ".join(words[i] for i in np.flatnonzero(~out).tolist()).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], ["id", "kept_text"])


FACTORS = "array<struct<start:bigint,n_words:bigint,ref_id:bigint,ref_start:bigint>>"


def _factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("start", "n_words", "ref_id", "ref_start")
    kind = pa.list_(pa.struct([(x, pa.int64()) for x in names]))
    for batch in batches:
        rows = [[dict(zip(names, f, strict=True)) for f in parse(found)] for found in _found(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["id", "factors"])


def _start() -> Column:
    return F.shiftright("place", COUNT_BITS)


def _later(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (anchor, content, id, key, place): those whose content stands earlier, with its first place, and the first rows of each content."""
    order = F.struct("id", _start().alias("start"), "key", "place")
    firsts = rows.groupBy("anchor", "content").agg(F.min(order).alias("f"), F.count("*").alias("n"))
    firsts = cut(firsts.select("anchor", "content", F.col("f.id").alias("ref_id"), F.col("f.start").alias("ref_start"), F.col("f.key").alias("ref_key"), F.col("f.place").alias("ref_place"), "n"), "firsts")
    again = firsts.where("n > 1").select("anchor", "content", "ref_id", "ref_start")
    later = rows.join(again, ["anchor", "content"]).where((F.col("id") != F.col("ref_id")) | (_start() != F.col("ref_start")))
    return later.select("id", "key", "place", "ref_id", "ref_start"), firsts


def _filter(shared: DataFrame) -> np.ndarray:
    """A bit for each shared anchor, modulo the filter's size. It spares rows from the exact join and may let any through.

    About 16 bits an anchor, FILTER_BITS at most, so it has a fixed largest size; beyond that it lets more through.
    """
    bits = min(FILTER_BITS, max(16, (16 * shared.count()).bit_length()))
    at = F.col("anchor").bitwiseAND(F.lit((1 << bits) - 1))
    bit = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)).cast("int")))
    rows = shared.groupBy(F.shiftright(at, 6).alias("word")).agg(bit.alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return words


def duplicate_places(docs: DataFrame) -> DataFrame:
    """(id, key, place, ref_id, ref_start): the blocks of windows of `docs` (id, key, text) that stand earlier in the corpus, and where."""
    schema = "anchor bigint, content bigint, id bigint, key bigint, place bigint"
    anchors = docs.mapInArrow(_anchors, "anchor bigint")
    shared = cut(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    bits = docs.sparkSession.sparkContext.broadcast(_filter(shared))
    rows = cut(docs.mapInArrow(_blocks(bits), schema).join(shared, "anchor"), "blocks")
    found, firsts = _later(rows)
    mixed = cut(firsts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "boundaries")
    listed = firsts.join(mixed, "anchor").groupBy(F.col("ref_id").alias("id"), F.col("ref_key").alias("key")).agg(F.collect_set("ref_place").alias("places"))
    windows = cut(docs.join(listed, ["id", "key"]).select("id", "key", "text", "places").mapInArrow(_windows, schema), "windows")
    checked, _ = _later(windows)
    return found.unionByName(checked)


def _with_found(docs: DataFrame) -> DataFrame:
    """(id, text, found) of each row of `docs`. Rows are told apart by id and text, so equal rows share one list and no others do."""
    text = F.col("text").cast("string")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    spans = duplicate_places(rows).groupBy("id", "key").agg(F.collect_set(F.struct("place", "ref_id", "ref_start")).alias("found"))  # a text's own blocks
    return rows.join(cut(spans, "spans"), ["id", "key"], "left").select("id", "text", "found")


def _named(found: DataFrame) -> DataFrame:
    return found.withColumn("doc_id", F.when(F.col("id") != NULL_ID, F.col("id"))).select("doc_id", *found.columns[1:])


def dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per row of `docs`.

    Null, empty and blank texts have no words. Rows with a null doc_id come
    before all others; rows that share a doc_id count as one document in the
    order, so of equal places neither removes the other. Windows are judged on
    the input. Other columns are ignored; an empty table gives no rows.
    """
    return _named(_with_found(docs).mapInArrow(_digests, "id bigint, n_words bigint, n_removed bigint, kept_sha256 string"))


def dedup_texts(docs: DataFrame) -> DataFrame:
    """doc_id, kept_text: what is left of each text, its words joined by one space."""
    return _named(_with_found(docs).mapInArrow(_kept_texts, "id bigint, kept_text string"))


def factors(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_words, ref_id, ref_start: the factors of each row of `docs`, in words; ref_id is null where a row without an id is the reference.

    A reference may be the document itself, further left. Rows that share a
    doc_id count as one document.
    """
    rows = _named(_with_found(docs).mapInArrow(_factors, f"id bigint, factors {FACTORS}")).select("doc_id", F.explode("factors").alias("f"))
    return rows.select("doc_id", "f.start", "f.n_words", F.when(F.col("f.ref_id") != NULL_ID, F.col("f.ref_id")).alias("ref_id"), "f.ref_start")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_digest(table(spark, sf_dir, "documents"))
