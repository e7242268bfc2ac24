"""Token counts by trie-shared dynamic programming.

Words are cut into pieces of a public vocabulary so that the sum of unigram
scores is highest. The vocabulary ranks its pieces but holds no probabilities,
and tokenizers are not trained here; Zipf's law gives the scores, -ln(r + ZIPF)
for a piece of rank r. The counts are therefore those of the best cut under
these scores, not of the model's own merges; README gives the difference. The
best score of a prefix does not depend on what follows, so the distinct words
of a partition are put in a trie and each shared prefix is scored once; a
word's count stands at its terminal node. Characters that no piece covers are
cut into UTF-8 bytes, one token each.

Each task scores the distinct words that it meets. Scoring each word of the
corpus once would take a shuffle of (document, word) pairs, more than the text.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm.common import table, text_slices

VOCABULARY = os.environ.get("WICKWORK_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")
ZIPF, START = 2.7, "▁"
#: Words a task remembers the counts of; then it starts anew.
REMEMBER = 400_000


def load_scores(path: str = VOCABULARY) -> tuple[dict[str, float], float]:
    """Scores by piece, and the score of a byte token."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = {model.id_to_piece(i): -math.log(rank + ZIPF) for rank, i in enumerate(plain)}
    return scores, -math.log(len(plain) + ZIPF)


def _step(word: str, i: int, best: list, scores: dict, byte: float, longest: int) -> tuple[float, int]:
    """Best (score, -tokens) of word[:i]; of equal scores the fewer tokens."""
    n = len(word[i - 1].encode("utf-8", "surrogatepass"))
    score, tokens = best[i - 1]
    top = (score + n * byte, tokens - n)
    for j in range(max(0, i - longest), i):
        s = scores.get(word[j:i])
        if s is not None:
            score, tokens = best[j]
            if (new := (score + s, tokens - 1)) > top:
                top = new
    return top


def trie_counts(words: list[str], scores: dict[str, float], byte: float) -> dict[str, int]:
    """Token count of each word. Words in order walk the trie depth first: what a word shares with the one before is not scored again."""
    longest = max(map(len, scores), default=1)
    out, best, last = {}, [(0.0, 0)], ""
    for word in sorted(words):
        text = START + word
        k = len(os.path.commonprefix((last, text)))
        del best[k + 1 :]
        for i in range(k + 1, len(text) + 1):
            best.append(_step(text, i, best, scores, byte, longest))
        out[word], last = -best[-1][1], text
    return out


def _counter(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, byte = model.value
        known: dict[bytes, int] = {}
        for batch in batches:
            tokens, words = [], []
            for _, texts in text_slices(batch.column(1)):
                split = [t.split() if t else [] for t in texts]
                if len(known) > REMEMBER:
                    known.clear()
                new = {w.decode(): w for w in set().union(*split).difference(known)}
                known.update((new[w], n) for w, n in trie_counts(list(new), scores, byte).items())
                tokens += [sum(map(known.__getitem__, s)) for s in split]
                words += [len(s) for s in split]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words, n_tokens: one row per row of `docs`, over whole texts.

    Words are what stands between spaces and U+0009 to U+000D. Null, empty and
    blank texts have 0 of both. Repeated rows get equal rows; other columns are ignored. The
    vocabulary is read by the driver and broadcast; it has a fixed size.
    """
    model = docs.sparkSession.sparkContext.broadcast(load_scores(vocabulary))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_counter(model), f"doc_id {kind}, n_words bigint, n_tokens bigint")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
