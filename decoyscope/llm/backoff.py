"""Stupid-backoff language-model scores from n-gram counts of the whole corpus.

The count table is partitioned by n-gram hash (buckets of the census); documents' exploded n-grams, one row of sorted
hashes per block and bucket, meet it there and bring the corpus counts back to their block, where every document's
word scores are summed. The score of a word is count(context word) / count(context) for the longest context whose
n-gram was seen at least `MIN_COUNT` times, times `ALPHA` for each shorter context taken; the last resort is the
word's share of all words. N-grams do not cross documents.

Edge cases: a null or empty text, or one without words, has 0 words, log score 0 and perplexity null; repeated rows
each get a row and each count; an empty table gives an empty result. Only doc_id and text are read, other columns do not
matter. N-grams are known by hashes of 56 bits (64 in corpora of over `SHORT_KEYS` n-grams).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .census import answers, corpus_counts, dealt, places
from .common import text_bytes
from .textkit import ALNUM, chunks, windows

ORDER = 3
ALPHA = 0.4
MIN_COUNT = 2
_ALL_WORDS = np.uint64((1 << 64) - 1)
"""Stands for the number of words among the n-gram hashes."""
SHORT_KEYS = 1 << 30
"""Up to so many n-grams, 56 bits of their hashes are kept: fewer than one in 10**7 then shares its key with another."""


def _grams(texts: pa.ChunkedArray, order: int, mask: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For n = 1 to order: hashes of all n-grams in text order; and the words of each text."""
    words, counts = [], []
    for chunk in chunks(texts):
        starts, ends, number = chunk.words(ALNUM)
        words.append(chunk.hasher(fold=True)(starts, ends))
        counts.append(number)
    words = np.concatenate(words) if words else np.zeros(0, dtype=np.uint64)
    counts = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
    return [windows(words, counts, n)[0] & np.uint64(mask) for n in range(1, order + 1)], counts


def _counter(order: int, mask: int):
    def count(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        grams, counts = _grams(rows.column("text"), order, mask)
        keys, number = np.unique(np.concatenate(grams), return_counts=True)
        return np.append(keys, _ALL_WORDS), np.append(number, counts.sum())

    return count


def word_scores(grams: list[np.ndarray], counts: np.ndarray, totals: list[np.ndarray], words: int, alpha: float, least: int) -> np.ndarray:
    """Natural logs of all words' scores; totals are the corpus counts of `grams`."""
    begin = np.cumsum(counts) - counts
    place = np.arange(counts.sum()) - np.repeat(begin, counts)
    text = np.repeat(np.arange(len(counts)), counts)
    score = np.log(totals[0] / max(words, 1))
    for n in range(2, len(grams) + 1):
        reach = np.flatnonzero(place >= n - 1)
        first = place[reach] - n + 1
        own = totals[n - 1][(np.cumsum(np.maximum(counts - n + 1, 0)) - np.maximum(counts - n + 1, 0))[text[reach]] + first]
        context = totals[n - 2][(np.cumsum(np.maximum(counts - n + 2, 0)) - np.maximum(counts - n + 2, 0))[text[reach]] + first]
        score[reach] = np.where(own >= least, np.log(own / np.maximum(context, 1)), np.log(alpha) + score[reach])
    return score


def _scorer(order: int, mask: int, alpha: float, least: int):
    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        grams, counts = _grams(rows.column("text"), order, mask)
        found = answers(told).astype(np.float64)
        totals = np.split(found[places(np.concatenate(grams))[0]], np.cumsum([len(gram) for gram in grams])[:-1])
        scores = word_scores(grams, counts, totals, int(found[-1]), alpha, least) if len(grams[0]) else np.zeros(0)
        sums = np.bincount(np.repeat(np.arange(len(counts)), counts), weights=scores, minlength=len(counts))
        return pa.table({"doc_id": rows.column("doc_id"), "n_words": pa.array(counts, pa.int64()), "log_score": pa.array(sums, pa.float64())})

    return run


def score(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, alpha: float = ALPHA, least: int = MIN_COUNT
) -> DataFrame:
    """One row per document: doc_id, n_words, log_score (natural log, summed) and perplexity."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    size = text_bytes(own)
    blocks = dealt(own, size, F.col("doc_id"), F.col("text"))
    items = order * size // 6  # words have about six bytes
    mask = ((1 << 64) - 1) ^ (0xFF if items <= SHORT_KEYS else 0)
    told = corpus_counts(blocks, _counter(order, mask), items)
    kind = own.schema["doc_id"].dataType.simpleString()
    scored = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_scorer(order, mask, alpha, least), f"doc_id {kind}, n_words long, log_score double")
    perplexity = F.when(F.col("n_words") > 0, F.exp(-F.col("log_score") / F.col("n_words")))
    return scored.select(F.col("doc_id").alias(doc_id), "n_words", "log_score", perplexity.alias("perplexity"))
