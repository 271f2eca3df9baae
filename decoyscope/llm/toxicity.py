"""Toxicity by maximum-scoring segments.

Every word gets a log-odds of toxic against clean text, learned from labelled documents under Dirichlet priors
in two steps: a word's share of toxic uses is drawn towards that of its stem (its first four characters), and
the stem's towards that of all words. Shifted down by `DRIFT`, the scores of clean text fall on average, and one
linear pass per document finds all maximal scoring segments. A segment's score is calibrated by its extreme-value
law (lambda and K from clean calibration documents): in clean text of n words, K n exp(-lambda S) segments of
score S or more are expected. The significant segments' evidence is added per document and turned into a
probability by a logistic curve fitted on the calibration documents.

Training reads about `MAX_LABELLED` labelled documents (by a hash of doc_id, of the rows
whose crc32 remainder is not 0); three quarters are counted, one quarter calibrates. Counts live in hashed
slots, so the model has a fixed size. Every document is scored, in one pass, without a shuffle.

Edge cases: a null or empty text has no words and the score of no evidence; null labels are ignored and of
several labels of a document the largest counts; a null doc_id is scored and not held out; without labelled
rows of both kinds no segment is significant and all scores are the share of toxic labels, or 0. Input columns
named like those of `SCORED` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import about, stored
from .textkit import ALNUM, Chunk, chunks

MAX_LABELLED = 30_000
WORD_BITS, STEM_BITS, STEM = 20, 18, 4
PRIOR = 2.0
DRIFT = 1.5
SIGNIFICANT = 0.05
"""Largest expected number of such segments in the document, were it clean."""

_SEGMENT = [("start", T.IntegerType()), ("end", T.IntegerType()), ("score", T.DoubleType()), ("expected", T.DoubleType())]
SCORED = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("segments", T.ArrayType(T.StructType([T.StructField(name, kind) for name, kind in _SEGMENT]))),
])
_SEGMENTS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _slots(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Word slots and stem slots of a chunk's words."""
    starts, ends, counts = chunk.words(ALNUM)
    spans = chunk.hasher(fold=True)
    leads = np.append(np.flatnonzero((chunk.data & 0xC0) != 0x80), len(chunk.data))
    points = chunk.code_points()
    stem_ends = np.minimum(ends, leads[np.minimum(points[starts] + STEM, len(leads) - 1)]) if len(starts) else ends
    words = (spans(starts, ends) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    stems = (spans(starts, stem_ends) >> np.uint64(64 - STEM_BITS)).astype(np.int64)
    return words, stems, (starts, ends, counts, points)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end exclusive, score), in order; linear in the number of words."""
    positive = scores > 0
    if not positive.any():
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    edges = np.flatnonzero(np.diff(np.concatenate(([False], positive, [False])).astype(np.int8)))
    found: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first, end, nearest candidate with a smaller sum before
    for first, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        low, high = total[first], total[end]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= low:
                j = found[j][4]
            if j < 0 or found[j][1] >= high:
                found.append((low, high, first, end, j))
                break
            low, first = found[j][0], found[j][2]
            del found[j:]
    return [(first, end, high - low) for low, high, first, end, _ in found]


@dataclass
class Model:
    toxic: np.ndarray  # uses in toxic training text, by word slot
    uses: np.ndarray
    stem_share: np.ndarray  # toxic share of a stem's uses, drawn towards that of all words
    base: float  # log-odds of that of all words
    rate: float = 1.0  # lambda
    scale: float = 1.0  # K
    intercept: float = 0.0
    slope: float = 0.0

    def word_scores(self, words: np.ndarray, stems: np.ndarray) -> np.ndarray:
        share = (self.toxic[words] + PRIOR * self.stem_share[stems]) / (self.uses[words] + PRIOR)
        return np.log(share / (1 - share)) - self.base - DRIFT

    def found(self, scores: np.ndarray) -> list[tuple[int, int, float, float]]:
        """Significant segments with their expected number in clean text."""
        out = []
        for first, end, score in segments(scores):
            expected = self.scale * max(len(scores), 1) * np.exp(-self.rate * score)
            if expected < SIGNIFICANT:
                out.append((first, end, score, expected))
        return out

    def evidence(self, found: list[tuple[int, int, float, float]]) -> float:
        return float(np.log1p(sum(-np.log(max(expected, 1e-300)) for *_, expected in found)))

    def probability(self, evidence: float | np.ndarray):
        return 1.0 / (1.0 + np.exp(-(self.intercept + self.slope * evidence)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts by slot: dense, cut in blocks, as rows (block, clean, toxic)."""
    table = np.zeros((2, (1 << WORD_BITS) + (1 << STEM_BITS)), dtype=np.int64)
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for chunk in chunks(batch.column("text")):
            words, stems, (_, _, counts, _) = _slots(chunk)
            label = np.repeat(toxic[chunk.first : chunk.first + len(chunk)], counts)
            for kind in (0, 1):
                table[kind, : 1 << WORD_BITS] += np.bincount(words[label == kind], minlength=1 << WORD_BITS)
                table[kind, 1 << WORD_BITS :] += np.bincount(stems[label == kind], minlength=1 << STEM_BITS)
    size = 1 << 14
    for block in range(table.shape[1] // size):
        part = table[:, block * size : (block + 1) * size]
        if part.any():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "counts": [part.tobytes()]})


def _summed(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(value.as_py(), dtype=np.int64) for value in rows.column("counts"))
    return pa.table({"block": rows.column("block").slice(0, 1), "counts": [total.tobytes()]})


def learned(counts: np.ndarray) -> Model:
    """The word model from clean and toxic counts by slot (word slots, then stem slots)."""
    toxic, uses = counts[1].astype(np.float64), counts.sum(axis=0).astype(np.float64)
    split = 1 << WORD_BITS
    share = float(np.clip(toxic[:split].sum() / max(uses[:split].sum(), 1), 1e-6, 1 - 1e-6))
    stem_share = (toxic[split:] + PRIOR * share) / (uses[split:] + PRIOR)
    return Model(toxic[:split].astype(np.float32), uses[:split].astype(np.float32), stem_share, float(np.log(share / (1 - share))))


def calibrated(model: Model, rows: list[tuple[int, np.ndarray]]) -> Model:
    """Fit the extreme-value law on clean rows and the curve on all; rows: label, word scores."""
    labels = np.array([label for label, _ in rows], dtype=np.float64)
    clean = [scores for label, scores in rows if label == 0 and len(scores)]
    if not clean or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        model.intercept, model.scale = float(np.log(np.clip(share, 1e-9, 1 - 1e-9) / (1 - np.clip(share, 1e-9, 1 - 1e-9)))), np.inf
        return model
    values, times = np.unique(np.round(np.concatenate(clean), 2), return_counts=True)
    weight = times / times.sum()
    low, high = 1e-3, 20.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (weight * np.exp(np.minimum(middle * values, 700))).sum() < 1 else (low, middle)
    model.rate = low
    tops = np.array([score for scores in clean for *_, score in segments(scores)] or [0.0])
    words = sum(map(len, clean))
    at = float(np.quantile(tops, 0.9))
    model.scale = max(int((tops >= at).sum()), 1) / (words * np.exp(-model.rate * at))
    evidence = np.array([model.evidence(model.found(scores)) for _, scores in rows])
    beta = np.zeros(2)
    design = np.stack([np.ones(len(labels)), evidence], axis=1)
    for _ in range(50):  # Newton's steps for a ridge-regularised logistic curve
        chance = 1 / (1 + np.exp(-design @ beta))
        slope = design.T @ (labels - chance) - 0.01 * beta
        curve = (design * (chance * (1 - chance))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    model.intercept, model.slope = float(beta[0]), max(float(beta[1]), 0.0)
    return model


def _labelled(labels: DataFrame, limit: int) -> DataFrame:
    """About `limit` rows (doc_id, toxic, calibrates) for training, chosen by a hash of doc_id."""
    rows = labels.where(F.col("toxic").isNotNull() & (remainder(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = about(rows.where(F.col("doc_id").isNotNull()), limit, F.col("doc_id"))
    return chosen.select("doc_id", F.col("toxic").cast("int").alias("toxic"), (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 0).alias("calibrates"))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", limit: int = MAX_LABELLED) -> Model:
    """Learn from labelled documents. What reaches the driver: counts by slot (fixed size) and about `limit` / 4 calibration texts' scores."""
    chosen = _labelled(labels, limit)  # about `limit` rows, so it may be broadcast
    training = stored(docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id"), "toxic-training")
    counted = (
        training.where(~F.col("calibrates")).select("text", "toxic").mapInArrow(_counts, "block int, counts binary")
        .groupBy("block").applyInArrow(_summed, "block int, counts binary").collect()
    )
    size = 1 << 14
    counts = np.zeros((2, (1 << WORD_BITS) + (1 << STEM_BITS)), dtype=np.int64)
    for row in counted:
        counts[:, row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["counts"], dtype=np.int64).reshape(2, size)
    model = learned(counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                values.astype(np.float32).tobytes() for chunk in chunks(batch.column("text")) for values in _document_scores(chunk, shared.value)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.binary())], names=["toxic", "scores"])

    rows = training.where("calibrates").select("text", "toxic").mapInArrow(scores, "toxic int, scores binary").toLocalIterator()
    return calibrated(model, [(row["toxic"], np.frombuffer(row["scores"], dtype=np.float32).astype(np.float64)) for row in rows])


def _document_scores(chunk: Chunk, model: Model) -> list[np.ndarray]:
    words, stems, (_, _, counts, _) = _slots(chunk)
    return np.split(model.word_scores(words, stems), np.cumsum(counts)[:-1])


def _score(texts: pa.Array, model: Model) -> list[pa.Array]:
    evidence, passages = [], []
    for chunk in chunks(texts):
        words, stems, (starts, ends, counts, points) = _slots(chunk)
        scores = model.word_scores(words, stems)
        begin = np.cumsum(counts) - counts
        for k, own in enumerate(np.split(scores, begin[1:])):
            found = model.found(own) if len(own) and own.max() > 0 else []
            evidence.append(model.evidence(found))
            at, base = begin[k], points[chunk.offsets[k]]
            passages.append([
                {"start": int(points[starts[at + a]] - base), "end": int(points[ends[at + b - 1]] - base), "score": s, "expected": e}
                for a, b, s, e in found
            ])
    return [pa.array(model.probability(np.array(evidence, dtype=np.float64)), pa.float64()), pa.array(passages, _SEGMENTS)]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with `score` (probability of a toxic label) and `segments` (toxic passages in code points)."""
    kept = docs.drop(*SCORED.names)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                list(batch.columns) + _score(batch.column(text), shared.value), names=batch.schema.names + SCORED.names
            )

    return kept.mapInArrow(run, T.StructType(list(kept.schema.fields) + list(SCORED.fields)))
