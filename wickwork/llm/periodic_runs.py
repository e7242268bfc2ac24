"""Periodic runs of words, found by longest common extensions over a difference cover.

A text is taken as numbers, one a word; the texts of a slice stand one after the
other, each closed by a number of its own, so that no match leaves its text.
Of all suffixes only those at positions of a difference cover modulo PERIOD are
sorted: whatever two positions are asked for, both reach a sampled one after
the same few words, which are compared one by one, and from there a range
minimum over the common prefixes of the sorted samples gives the rest.

A run of period p and at least three periods holds some multiple i of p with
i + p. So for each p only the pairs (i, i + p) on the grid of p are asked for,
n / p of them and n log n in all; most differ in their first word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm.common import table, text_slices

#: Each difference modulo PERIOD is one of two elements of COVER.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: A run has LEAST words and TIMES periods at least.
LEAST, TIMES = 24, 3
#: Grid points that are looked at together.
POINTS = 1 << 21


def _shifts() -> np.ndarray:
    """By residues (a, b): the least d for which a + d and b + d are both in the cover."""
    held = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    return np.array([[next(d for d in range(PERIOD) if held[a + d] and held[b + d]) for b in range(PERIOD)] for a in range(PERIOD)])


SHIFTS = _shifts()


class Extensions:
    """Longest common extensions of a row of numbers below 2^31, whose last number occurs once."""

    def __init__(self, numbers: np.ndarray):
        n = len(numbers)
        # What follows the end is different at each place, so that no comparison runs over it.
        self.words = np.concatenate([numbers, numbers.max() + 1 + np.arange(2 * PERIOD)]).astype(np.int64)
        places = [np.arange(d, n, PERIOD) for d in COVER]
        place = np.concatenate(places)
        last = np.zeros(len(place), bool)
        last[np.cumsum([len(p) for p in places if len(p)]) - 1] = True
        packed = []
        for k in range(0, PERIOD, 2):
            column = self.words[place + k]
            packed.append(column << 31 | self.words[place + k + 1] if k + 1 < PERIOD else column)
        order = np.lexsort(packed[::-1])
        new = np.zeros(len(place), bool)
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in packed], axis=0)
        names = [np.empty(len(place), np.int64)]
        names[0][order] = np.cumsum(new)
        # Prefix doubling over blocks of PERIOD words; a class of positions is closed by the text's last number.
        ends = np.flatnonzero(last)[np.searchsorted(np.flatnonzero(last), np.arange(len(place)))]
        while names[-1].max(initial=0) + 1 < len(place):
            step = 1 << (len(names) - 1)
            after = np.arange(len(place)) + step
            rest = np.where(after <= ends, names[-1][np.minimum(after, len(place) - 1)] + 1, 0)
            names.append(np.unique(names[-1] * (len(place) + 1) + rest, return_inverse=True)[1])
        order = np.argsort(names[-1])
        self.rank = np.full(len(self.words), -1)
        self.rank[place] = names[-1]
        self.lowest = [self._prefixes(order, place, ends, names)]
        while (step := 1 << len(self.lowest) - 1) * 2 <= len(place):
            row = self.lowest[-1]
            self.lowest.append(np.minimum(row[:-step], row[step:]))

    def _prefixes(self, order, place, ends, names) -> np.ndarray:
        """Words that each sorted sample has in common with the one before it."""
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(order), np.int64)
        for k in range(len(names) - 1, -1, -1):
            step = 1 << k
            inside = (a <= ends[a]) & (b <= ends[b])
            same = inside & (names[k][a] == names[k][b]) & (a + step <= ends[a]) & (b + step <= ends[b])
            common[1:] += np.where(same, step * PERIOD, 0)
            a, b = np.where(same, a + step, a), np.where(same, b + step, b)
        left, right, live = place[a], place[b], np.arange(len(a))
        for d in range(PERIOD):
            live = live[self.words[left[live] + d] == self.words[right[live] + d]]
            common[1 + live] += 1
        return common

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers from each place of `i` on are those from `j` on; i < j."""
        shift = SHIFTS[i % PERIOD, j % PERIOD]
        out, live = np.zeros(len(i), np.int64), np.arange(len(i))
        for d in range(PERIOD):
            here = live[shift[live] == d]
            if len(here):
                a, b = self.rank[i[here] + d], self.rank[j[here] + d]
                low, high = np.minimum(a, b) + 1, np.maximum(a, b)
                level = np.frexp((high - low + 1).astype(float))[1] - 1
                found = np.empty(len(here), np.int64)
                for k in np.unique(level):
                    use = level == k
                    found[use] = np.minimum(self.lowest[k][low[use]], self.lowest[k][high[use] - (1 << int(k)) + 1])
                out[here] = d + found
            live = live[shift[live] > d]
            live = live[self.words[i[live] + d] == self.words[j[live] + d]]
            out[live] = d + 1
            if not len(live):
                break
        return out


def _grid(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place of i, p) of all grid points i with i + p inside their text, some POINTS at a time."""
    each = sizes // TIMES
    text = np.repeat(np.arange(len(sizes)), each)
    period = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each) + 1
    count = (sizes[text] - 1) // period
    upto = np.cumsum(count)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + POINTS, "right")))
        c = count[at:to]
        k = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        p = np.repeat(period[at:to], c)
        own = np.repeat(text[at:to], c)
        yield own, starts[own] + k * p, p
        at = to


def find_runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Of each text, given as numbers: its runs as rows (start, length, smallest period), by start and period.

    A run is a stretch of at least LEAST words and TIMES periods that no
    neighbouring word extends with the same period.
    """
    out = [np.zeros((0, 3), np.int64) for _ in texts]
    long_ = [t for t, x in enumerate(texts) if len(x) >= LEAST]
    if not long_:
        return out
    sizes = np.array([len(texts[t]) for t in long_])
    starts = np.cumsum(sizes + 1) - sizes - 1
    top = max(int(texts[t].max()) for t in long_) + 1
    numbers = np.concatenate([x for k, t in enumerate(long_) for x in (texts[t], [top + k])])
    numbers = np.unique(numbers, return_inverse=True)[1]
    words, extend, found = numbers, None, []
    for own, i, p in _grid(starts, sizes):
        use = words[i] == words[i + p]
        if not use.any():
            continue
        extend = extend or Extensions(numbers)
        own, i, p = own[use], i[use], p[use]
        ahead = extend(i, i + p)
        # The first grid point of a run is less than p behind its start.
        use = ahead > np.maximum(LEAST, TIMES * p) - 2 * p
        own, i, p, ahead = own[use], i[use], p[use], ahead[use]
        inner = i - starts[own]
        again = np.zeros(len(i), bool)
        before = np.flatnonzero(inner >= p)
        again[before] = extend(i[before] - p[before], i[before]) >= p[before]
        own, i, p, ahead, inner = (x[~again] for x in (own, i, p, ahead, inner))
        # How far the run reaches back: the largest k for which the k words before i are those before i + p.
        low, high = np.zeros(len(i), np.int64), np.minimum(p - 1, inner)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_] + 1) // 2
            fits = extend(i[open_] - mid, i[open_] - mid + p[open_]) >= mid
            low[open_[fits]] = mid[fits]
            high[open_[~fits]] = mid[~fits] - 1
        length = low + p + ahead
        use = length >= np.maximum(LEAST, TIMES * p)
        found.append(np.stack([own, inner - low, length, p], axis=1)[use])
    if found and len(runs := np.concatenate(found)):
        # A stretch has many periods, multiples of its smallest.
        runs = runs[np.lexsort(runs.T[[3, 2, 1, 0]])]
        new = np.ones(len(runs), bool)
        new[1:] = (runs[1:, :3] != runs[:-1, :3]).any(axis=1)
        runs = runs[new]
        runs = runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]
        edges = np.searchsorted(runs[:, 0], np.arange(len(long_) + 1))
        for k, t in enumerate(long_):
            out[t] = runs[edges[k] : edges[k + 1], 1:]
    return out


def planted(words: list, doc_id: int | None) -> list:
    """The words of a document, a tenth of which repeat a passage from some place on; those of a document without an id stay."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    passage = words[a : a + p]
    return words[:a] + (passage * ((n - a) // p + 1))[: n - a]


def _digests(words: list, runs: np.ndarray) -> tuple:
    """(n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of a text and its runs."""
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
    best = (None,) * 4
    if len(runs):
        s, n, q = runs[np.lexsort((runs[:, 2], runs[:, 0], -(runs[:, 1] / runs[:, 2])))[0]].tolist()
        best = (s, n, q, 1000 * n // q)
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
    return len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


RESULT = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
LIST = "doc_id bigint, start bigint, length bigint, period bigint"


def _numbered(texts: list[list]) -> list[np.ndarray]:
    known: dict = {}
    return [np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) for words in texts]


def _slices(batches: Iterator[pa.RecordBatch], change):
    for batch in batches:
        for start, texts in text_slices(batch.column(1)):
            ids = batch.column(0).slice(start, len(texts)).to_pylist()
            words = [change((t or b"").split(), i) for i, t in zip(ids, texts, strict=True)]
            yield ids, words, find_runs(_numbered(words))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, _, runs in _slices(batches, lambda words, _: words):
        columns = np.concatenate([*runs, np.zeros((0, 3), np.int64)]).T
        own = [i for i, r in zip(ids, runs, strict=True) for _ in range(len(r))]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *[pa.array(c) for c in columns]], ["doc_id", "start", "length", "period"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in RESULT.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    for ids, words, runs in _slices(batches, planted):
        rows = [(i, *_digests(w, r)) for i, w, r in zip(ids, words, runs, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, period: a row for each periodic run of words in each row of `docs`.

    A run has at least LEAST words and TIMES periods; its period is its
    smallest. Texts that are null, empty, blank or short have none. Repeated
    rows have theirs again, other columns are ignored.
    """
    return _plain(docs).mapInArrow(_listed, LIST)


def run_digests(docs: DataFrame) -> DataFrame:
    """The columns of RESULT, one row per row of `docs`, after passages are planted in some (`planted`).

    Of the run of most periods (ties: the first, then the shortest period)
    start, length, period and thousandths of periods, null where there is none;
    digests of the list of all runs and of the words that are left when each
    run keeps its first period. Null and blank texts have no run and the digests
    of nothing. No text is planted in where doc_id is null.
    """
    return _plain(docs).mapInArrow(_summed, RESULT)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"))
