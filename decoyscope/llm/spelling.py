"""Spelling variants: words one edit apart, found by search schemes on bidirectional FM-indexes of the vocabulary.

1. Words are counted: maximal runs of letters, A-Z folded, some of them damaged on purpose (`damage`). The vocabulary
   holds those of at least `MIN_LETTERS` code points that occur at least `MIN_COUNT` times.
2. Of two words one edit apart, cut the first at its middle: the other begins with its left half or ends with its right half.
   So a word is sent under both halves of every length that a neighbour can have; a key (side, length, half) is shared by all words
   that one search can meet. Keys are dealt into index shards of about `SHARD` words; a key of more is cut in parts by a
   hash of its words, and its searches go to every part.
3. A shard is a bidirectional FM-index over its words, delimited: suffix order and wavelet matrix of the text and of its
   reverse. A search matches one half and its delimiter exactly, then extends across the other half to the other delimiter,
   allowing one inserted, deleted or replaced code point. Searches of one length advance together, as arrays of
   suffix-rank intervals in both texts. As the words are in order, the rank of `<delimiter>word` is the word's number.
4. A word's form is its neighbour of largest count; forms are followed by pointer doubling to the root.

The corpus is read once; what follows grows with the vocabulary. Counts leave a task summed up per batch.

Edge cases: a null text has no runs; a null doc_id reads as an empty string; repeated rows count as often as they occur; neighbours of
equal count are told apart by code-point order; long texts are read whole, in pieces; an empty table gives an empty
result. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .textkit import pieces

MIN_LETTERS = 6
MIN_COUNT = 5
FORM_FACTOR = 5
"""A form is at least this many times as frequent as its word."""
DAMAGED = 199
"""One in this many (document, run) pairs loses a code point."""
SHARD = 1 << 15
"""Rows of one index shard, about; also the most that a key has before it is cut."""

_RUN = re.compile(f"[a-zÀ-ÿ]{{{MIN_LETTERS},}}")


def damage(run: str, doc: int) -> str:
    """The run without one code point if its checksum, continued from that of its document, says so."""
    h = crc32(run.encode(), doc)
    return run if h % DAMAGED else run[: h % len(run)] + run[h % len(run) + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: Counter[str] = Counter()
        for doc, body in zip(batch.column("doc").to_pylist(), batch.column("body")):
            start = crc32(f"{doc}:".encode())
            for piece in pieces(body.as_buffer().to_pybytes()) if body.is_valid else ():
                for run, n in Counter(_RUN.findall(piece.lower().decode(errors="replace"))).items():
                    total[damage(run, start)] += n
        words = [word for word in total if len(word) >= MIN_LETTERS]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([total[word] for word in words], pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words that are long and frequent enough, and how often each occurs."""
    own = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc"), F.col(text).cast("binary").alias("body"))
    counted = own.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= MIN_COUNT)


LETTERS = 26 + 64
"""a to z, then U+00C0 to U+00FF; 0 is the delimiter."""
LEVELS = LETTERS.bit_length()
_CODE = np.zeros(256, dtype=np.uint8)
_CODE[0x61:0x7B] = np.arange(1, 27)
_CODE[0xC0:0x100] = np.arange(27, 91)


def encoded(word: str) -> np.ndarray:
    return _CODE[np.frombuffer(word.encode("latin-1"), dtype=np.uint8)]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the cyclic suffixes in order, by prefix doubling; the text begins and ends with the only double delimiter."""
    rank = text.astype(np.int64)
    step = 1
    while True:
        both = rank * (max(len(text), LETTERS) + 1) + np.roll(rank, -step)
        order = np.argsort(both, kind="stable")
        new = np.empty(len(text), dtype=np.int64)
        new[order] = np.concatenate(([0], np.cumsum(both[order][1:] != both[order][:-1])))
        rank = new
        if rank[order[-1]] == len(text) - 1:
            return order
        step *= 2


class Ranks:
    """Wavelet matrix of a text's last column, and where each letter's suffixes begin."""

    def __init__(self, text: np.ndarray):
        column = text[suffix_order(text) - 1]
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=LETTERS + 1))))[:-1]
        self.zeros, self.levels = [], []
        at = np.zeros(LETTERS + 1, dtype=np.int64)
        letters = np.arange(LETTERS + 1)
        for level in range(LEVELS - 1, -1, -1):
            bit = (column >> level) & 1
            zero = np.concatenate(([0], np.cumsum(bit == 0)))
            self.levels.append(zero)
            self.zeros.append(int(zero[-1]))
            at = np.where((letters >> level) & 1, zero[-1] + at - zero[at], zero[at])
            column = np.concatenate((column[bit == 0], column[bit == 1]))
        self.first = at
        """Where each letter's block begins below the last level."""

    def step(self, letter: np.ndarray, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals after one more letter in front: begin, size, and how many suffixes had a smaller letter there."""
        high, less = low + size, np.zeros(len(low), dtype=np.int64)
        for level, zero, zeros in zip(range(LEVELS - 1, -1, -1), self.levels, self.zeros):
            one = ((letter >> level) & 1).astype(bool)
            a, b = zero[low], zero[high]
            less += np.where(one, b - a, 0)
            low, high = np.where(one, zeros + low - a, a), np.where(one, zeros + high - b, b)
        return self.begin[letter] + low - self.first[letter], high - low, less

    def steps(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All letters that occur in front: whose interval, the letter, begin, size, and suffixes of smaller letters."""
        own, high = np.arange(len(low)), low + size
        letter = less = np.zeros(len(low), dtype=np.int64)
        for zero, zeros in zip(self.levels, self.zeros):
            a, b = zero[low], zero[high]
            parts = ((own, 2 * letter, a, b, less), (own, 2 * letter + 1, zeros + low - a, zeros + high - b, less + b - a))
            own, letter, low, high, less = (np.concatenate(pair) for pair in zip(*parts))
            there = low < high
            own, letter, low, high, less = own[there], letter[there], low[there], high[there], less[there]
        return own, letter, self.begin[letter] + low - self.first[letter], high - low, less


class Intervals:
    """Searches under way: which query each serves, and its interval in the text and in the reverse text."""

    def __init__(self, query: np.ndarray, low: np.ndarray, back: np.ndarray, size: np.ndarray):
        self.query, self.low, self.back, self.size = query, low, back, size

    def where(self, mask: np.ndarray) -> Intervals:
        return Intervals(self.query[mask], self.low[mask], self.back[mask], self.size[mask])

    def __add__(self, other: Intervals) -> Intervals:
        pairs = ((self.query, other.query), (self.low, other.low), (self.back, other.back), (self.size, other.size))
        return Intervals(*(np.concatenate(pair) for pair in pairs))

    def turned(self) -> Intervals:
        return Intervals(self.query, self.back, self.low, self.size)


class Index:
    """Bidirectional FM-index over words in order; the word of number k has rank k + 1 among the delimiters."""

    def __init__(self, words: list[str]):
        text = _CODE[np.frombuffer(("\0" + "\0".join(words) + "\0").encode("latin-1"), dtype=np.uint8)]
        self.sides = Ranks(text), Ranks(text[::-1])
        self.words = len(words)

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of queries of one length, as rows of letters: (query, word number) for all words one edit away."""
        n = queries.shape[1]
        cut = n // 2
        # An index of the reverse text reads a word's end as its beginning: the same search serves both halves.
        right = self._search(self.sides, queries[:, :cut], queries[:, cut:])
        left = self._search(self.sides[::-1], queries[:, ::-1][:, : n - cut], queries[:, ::-1][:, n - cut :]).turned()
        found = right + left
        both = np.unique(found.query * (self.words + 1) + found.low - 1)
        return both // (self.words + 1), both % (self.words + 1)

    def _search(self, sides: tuple[Ranks, Ranks], exact: np.ndarray, rest: np.ndarray) -> Intervals:
        """Words that begin with `exact` and go on with one edit of `rest`."""
        front, back = sides
        number = len(exact)
        none = np.zeros(0, dtype=np.int64)
        begun = Intervals(np.arange(number), np.zeros(number, np.int64), np.zeros(number, np.int64), np.full(number, len(front.levels[0]) - 1))
        for k in range(exact.shape[1] - 1, -1, -1):
            begun = self._extended(front, begun, exact[begun.query, k])
        clean = self._extended(front, begun, np.zeros(len(begun.query), np.int64)).turned()
        edited = Intervals(none, none, none, none)
        for k in range(rest.shape[1] + 1):
            own, letter, low, size, less = back.steps(clean.low, clean.size)
            grown = Intervals(clean.query[own], low, clean.back[own] + less, size)
            if k == rest.shape[1]:
                edited = edited + grown.where(letter != 0)
                break
            other = (letter != 0) & (letter != rest[grown.query, k])
            edited = edited + grown.where(other)  # inserted before the next letter
            edited = self._extended(back, edited, rest[edited.query, k]) + grown.where(other) + clean  # matched; replaced; deleted
            clean = grown.where(letter == rest[grown.query, k])
        return self._extended(back, edited, np.zeros(len(edited.query), np.int64)).turned()

    @staticmethod
    def _extended(side: Ranks, at: Intervals, letter: np.ndarray) -> Intervals:
        low, size, less = side.step(letter.astype(np.int64), at.low, at.size)
        return Intervals(at.query, low, at.back + less, size).where(size > 0)


def _matched(rows: pa.Table) -> pa.Table:
    """All neighbours of a shard's queries among its words."""
    held = dict(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist()))
    own = rows.column("indexed").to_numpy(zero_copy_only=False)
    words = sorted({word for word, there in zip(rows.column("word").to_pylist(), own) if there})
    asked = sorted({word for word, query in zip(rows.column("word").to_pylist(), rows.column("query").to_pylist()) if query}, key=len)
    out: dict[str, list] = {"word": [], "near": [], "near_n": []}
    low = 0
    index = Index(words) if words else None
    while index and low < len(asked):
        high = low
        while high < len(asked) and len(asked[high]) == len(asked[low]):
            high += 1
        for query, number in zip(*(x.tolist() for x in index.near(np.stack([encoded(word) for word in asked[low:high]])))):
            out["word"].append(asked[low + query])
            out["near"].append(words[number])
            out["near_n"].append(held[words[number]])
        low = high
    return pa.table(out, schema=pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())]))


def neighbours(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, near, near_n) for all words one edit apart of the vocabulary (word, n); a pair can come twice."""
    length = F.length("word")
    sent = words.withColumn("length", F.explode(F.array(length - 1, length, length + 1))).where(F.col("length") >= MIN_LETTERS)
    cut = F.floor(F.col("length") / 2).cast("int")
    left, right = F.substring("word", F.lit(1), cut), F.substring("word", length - F.col("length") + cut + 1, F.col("length"))
    sent = sent.withColumn("half", F.explode(F.array(F.concat(F.lit("<"), left), F.concat(F.lit(">"), right))))
    sent = sent.select("word", "n", F.xxhash64("length", "half").alias("key"), (F.col("length") == length).alias("query"))
    sent = stored(sent, "spelling-halves")
    keys = sent.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("query").alias("asked")).where("asked and size > 1")
    keys = keys.select("key", F.ceil(F.col("size") / shard).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    parts = F.when(F.col("query"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(part))
    dealt = sent.join(keys, "key").withColumn("part", F.explode(parts)).withColumn("indexed", F.col("part") == part)
    number = max(1, -(-sent.count() // shard))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("key", "part"), F.lit(number)))
    return dealt.select("shard", "word", "n", "query", "indexed").groupBy("shard").applyInArrow(_matched, "word string, near string, near_n long")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    """One row per word of the vocabulary: word, n, n_near, form, form_n, root."""
    words = stored(vocabulary(docs, doc_id, text), "vocabulary")
    near = neighbours(words, shard).distinct().groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best")
    )
    joined = words.join(near.select("word", "n_near", F.col("best.word").alias("near"), (-F.col("best.n")).alias("near_n")), "word", "left")
    taken = F.col("near_n") >= FORM_FACTOR * F.col("n")
    found = stored(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("near")).alias("form"), F.when(taken, F.col("near_n")).alias("form_n"),
    ), "word-forms")
    up = stored(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "word-roots")
    while True:  # a form is five times as frequent as its word: few doublings reach every root
        above = up.select(F.col("word").alias("root"), F.col("root").alias("over"))
        if up.join(above, "root", "left_semi").isEmpty():
            break
        up = stored(up.join(above, "root", "left").select("word", F.coalesce("over", "root").alias("root")), "word-roots")
    return found.join(up, "word", "left").withColumn("root", F.coalesce("root", "word"))
