"""Benchmark decontamination with an FM-index per training shard.

A shard is a few megabytes of neighbouring documents of a partition. Its words become symbols (words that no
test phrase has are separators), the symbol string is suffix-sorted and kept as its Burrows-Wheeler transform
in a wavelet matrix. Test phrases, the 10-word windows of the benchmark items, are searched backward, all at
once, by ranks in the wavelet matrix; occurrences are located by walking to the next sampled suffix position;
overlapping occurrences merge into removal spans. Nothing is shuffled: documents stay where they were read and
only the phrases travel, in blocks of bounded size (`BLOCK_BYTES` of item text), one pass per block.

Words are case-folded (A-Z) runs of ASCII letters, digits and non-ASCII characters. Edge cases: a null or empty
document has no words and no hits; a null, empty or wordless item has no window; an item with a null id marks
words but is not named; an item shorter than a window is one window; repeated documents each get a row,
repeated items count once; an empty benchmark finds nothing. Columns of the documents named like those of
`FOUND` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_bytes
from .textkit import ALNUM, Chunk, chunks

WINDOW = 10
BLOCK_BYTES = 4 << 20
SAMPLE = 8
"""Every so many positions (and every first position of a stretch) a suffix position is kept."""


def _pairs(*names: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(name, T.IntegerType()) for name in names]))


FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("hit_words", _pairs("first", "last")), T.StructField("spans", _pairs("start", "end")),
])
_RANGE = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit plane per level."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = []
        current = sequence
        for shift in reversed(range(max(1, int(symbols - 1).bit_length()))):
            ones = ((current >> shift) & 1).astype(bool)
            zeros_before = np.zeros(len(current) + 1, dtype=np.int64)
            np.cumsum(~ones, out=zeros_before[1:])
            self.levels.append((shift, zeros_before))
            current = np.concatenate([current[~ones], current[ones]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low, high = np.zeros_like(upto), upto
        for shift, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            low_zeros, high_zeros = zeros[low], zeros[high]
            low = np.where(one, zeros[-1] + low - low_zeros, low_zeros)
            high = np.where(one, zeros[-1] + high - high_zeros, high_zeros)
        return high - low


def suffix_order(sequence: np.ndarray) -> np.ndarray:
    """Suffix positions in order; each 0 is a separator of its own, smaller than later ones and all symbols."""
    stops = sequence == 0
    rank = np.where(stops, np.cumsum(stops) - 1, sequence + stops.sum())
    step = 1
    while True:
        second = np.zeros(len(rank), dtype=np.int64)
        second[:-step] = rank[step:] + 1
        key = rank * (rank.max() + 2) + second
        order = np.argsort(key, kind="stable")
        changes = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank = np.empty(len(key), dtype=np.int64)
        rank[order] = changes
        if changes[-1] == len(key) - 1 or step >= len(key):
            return order
        step *= 2


class FMIndex:
    """Full-text index of a symbol sequence; 0 separates stretches and ends the sequence."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        order = suffix_order(sequence)
        self._last = sequence[order - 1]
        self._ranks = WaveletMatrix(self._last, symbols)
        self._before = np.concatenate(([0], np.cumsum(np.bincount(sequence, minlength=symbols))))
        opens = np.concatenate(([True], sequence[:-1] == 0))
        self._sampled = opens[order] | (order % SAMPLE == 0)
        self._slot = np.cumsum(self._sampled) - 1
        self._samples = order[self._sampled]
        self._size = len(sequence)

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of right-aligned phrases (rows of a matrix, 0 to the left)."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self._size)
        alive = np.arange(len(phrases))
        for step in range(1, phrases.shape[1] + 1):
            alive = alive[(lengths[alive] >= step) & (low[alive] < high[alive])]
            if not len(alive):
                break
            symbol = phrases[alive, -step]
            low[alive] = self._before[symbol] + self._ranks.rank(symbol, low[alive])
            high[alive] = self._before[symbol] + self._ranks.rank(symbol, high[alive])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: steps back to a sampled row, and its position."""
        rows = rows.copy()
        steps = np.zeros(len(rows), dtype=np.int64)
        away = np.flatnonzero(~self._sampled[rows])
        while len(away):
            symbol = self._last[rows[away]]
            rows[away] = self._before[symbol] + self._ranks.rank(symbol, rows[away])
            steps[away] += 1
            away = away[~self._sampled[rows[away]]]
        return self._samples[self._slot[rows]] + steps


@dataclass
class Phrases:
    """Distinct windows of a block of items, as symbols, and which items have each."""

    vocabulary: np.ndarray  # sorted word hashes; symbol k + 1 is entry k
    symbols: np.ndarray  # right-aligned
    lengths: np.ndarray
    owners: list[tuple[str, ...]]

    @classmethod
    def of(cls, items: list[tuple[str | None, str | None]], width: int = WINDOW) -> Phrases:
        found: dict[tuple[int, ...], set[str]] = {}
        texts = pa.array([text for _, text in items], pa.string())
        for chunk in chunks(texts):
            starts, ends, counts = chunk.words(ALNUM)
            hashes = chunk.hasher(fold=True)(starts, ends).tolist()
            at = 0
            for k, count in enumerate(counts.tolist()):
                words = hashes[at : at + count]
                at += count
                name = items[chunk.first + k][0]
                for first in range(max(1, count - width + 1) if count else 0):
                    owners = found.setdefault(tuple(words[first : first + width]), set())
                    if name is not None:
                        owners.add(name)
        vocabulary = np.unique(np.array([word for phrase in found for word in phrase], dtype=np.uint64))
        lengths = np.array([len(phrase) for phrase in found], dtype=np.int64)
        symbols = np.zeros((len(found), width), dtype=np.int64)
        for row, phrase in enumerate(found):
            symbols[row, width - len(phrase) :] = np.searchsorted(vocabulary, np.array(phrase, dtype=np.uint64)) + 1
        return cls(vocabulary, symbols, lengths, [tuple(owners) for owners in found.values()])


def _stretches(symbols: np.ndarray, counts: np.ndarray, least: int) -> np.ndarray:
    """Places of words in stretches of known words, inside one text, that a shortest phrase fits in."""
    known = symbols > 0
    edge = np.zeros(len(symbols) + 1, dtype=bool)
    edge[np.cumsum(counts) - counts] = True
    edge[-1] = True
    opens = np.flatnonzero(known & (edge[:-1] | ~np.concatenate(([False], known[:-1]))))
    closes = np.flatnonzero(known & (edge[1:] | ~np.concatenate((known[1:], [False])))) + 1
    long = closes - opens >= least
    opens, closes = opens[long], closes[long]
    size = closes - opens
    return np.repeat(opens - (np.cumsum(size) - size), size) + np.arange(size.sum()), size


def occurrences(chunk: Chunk, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """First words, lengths and phrase numbers of all occurrences in a shard, and the shard's words."""
    starts, ends, counts = chunk.words(ALNUM)
    none = np.zeros(0, dtype=np.int64)
    if not len(starts) or not len(phrases.vocabulary):
        return none, none, none, (starts, ends, counts)
    hashes = chunk.hasher(fold=True)(starts, ends)
    at = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
    symbols = np.where(phrases.vocabulary[at] == hashes, at + 1, 0)
    place, size = _stretches(symbols, counts, int(phrases.lengths.min()))
    if not len(place):
        return none, none, none, (starts, ends, counts)
    slot = np.arange(len(place)) + np.repeat(np.arange(len(size)), size)  # a separator after each stretch
    sequence = np.zeros(len(place) + len(size), dtype=np.int64)
    sequence[slot] = symbols[place]
    word = np.zeros(len(sequence), dtype=np.int64)
    word[slot] = place
    index = FMIndex(sequence, len(phrases.vocabulary) + 1)
    low, high = index.ranges(phrases.symbols, phrases.lengths)
    number = high - low
    phrase = np.repeat(np.arange(len(low)), number)
    rows = np.arange(len(phrase)) + np.repeat(low - (np.cumsum(number) - number), number)
    return word[index.locate(rows)], phrases.lengths[phrase], phrase, (starts, ends, counts)


def _merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of overlapping or touching ranges (ends exclusive), in order."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    opens = np.concatenate(([True], first[1:] > last[:-1]))
    return first[opens], last[np.concatenate((np.flatnonzero(opens)[1:] - 1, [len(last) - 1]))]


def _search(batch: pa.RecordBatch, text: str, phrases: Phrases) -> list[pa.Array]:
    names = batch.schema.names
    earlier = batch.column("hit_words").to_pylist() if "hit_words" in names else None
    named = batch.column("items").to_pylist() if "items" in names else None
    n_words, n_hit, items, ranges, spans = [], [], [], [], []
    for chunk in chunks(batch.column(text)):
        first, length, phrase, (starts, ends, counts) = occurrences(chunk, phrases)
        points = chunk.code_points()
        begin = np.cumsum(counts) - counts
        text_of = np.searchsorted(begin + counts, first, side="right")
        order = np.argsort(text_of, kind="stable")
        cuts = np.searchsorted(text_of[order], np.arange(len(chunk) + 1))
        for k in range(len(chunk)):
            mine = order[cuts[k] : cuts[k + 1]]
            low, high = first[mine] - begin[k], first[mine] - begin[k] + length[mine]
            who = {name for p in phrase[mine] for name in phrases.owners[p]}
            if earlier is not None:
                before = earlier[chunk.first + k]
                low = np.concatenate((low, np.array([x["first"] for x in before], dtype=np.int64)))
                high = np.concatenate((high, np.array([x["last"] for x in before], dtype=np.int64)))
                who |= set(named[chunk.first + k])
            if len(low):
                low, high = _merged(low, high)
            base, at = points[chunk.offsets[k]], begin[k]
            n_words.append(int(counts[k]))
            n_hit.append(int((high - low).sum()))
            items.append(sorted(who))
            ranges.append([{"first": int(a), "last": int(b)} for a, b in zip(low, high)])
            spans.append([
                {"start": int(points[starts[at + a]] - base), "end": int(points[ends[at + b - 1]] - base)} for a, b in zip(low, high)
            ])
    return [
        pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())),
        pa.array(ranges, _RANGE), pa.array(spans, _SPAN),
    ]


def find(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents with the columns `FOUND`: words, hit words, sorted item ids, and spans in words and code points."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text"))
    blocks = max(1, -(-text_bytes(items) // block_bytes))
    found = docs.drop(*FOUND.names)
    schema = T.StructType(list(found.schema.fields) + list(FOUND.fields))
    for block in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        phrases = spark.sparkContext.broadcast(Phrases.of([tuple(row) for row in own.collect()], width))

        def run(batches: Iterator[pa.RecordBatch], phrases=phrases) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = _search(batch, text, phrases.value)
                rest = [name for name in batch.schema.names if name not in FOUND.names]
                yield pa.RecordBatch.from_arrays([batch.column(name) for name in rest] + columns, names=rest + FOUND.names)

        found = found.mapInArrow(run, schema)
    return found


def cut(text: Column, spans: Column) -> Column:
    """The text without its removal spans; what stood on both sides of a span is kept apart by a line end."""
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
    pieces = F.zip_with(ends, starts, lambda low, high: F.substring(text, low + 1, high - low))
    return F.when(F.size(spans) > 0, F.array_join(pieces, "\n")).otherwise(text)
