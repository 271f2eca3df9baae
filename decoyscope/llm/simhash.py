"""SimHash near duplicates: deletion-variant signatures, joined by equality and verified.

1. A document's fingerprint has a bit set if over half of its shingles' XXH64 hashes have it. Shingles are three
   neighbouring words, repeats included; fewer words are one shingle; no words give fingerprint zero. Documents of equal
   fingerprint are one row from here on.
2. Two fingerprints that differ in at most three of 64 bits differ in at most one bit of one of their 32-bit halves. So each
   half is indexed once per bit with that bit left out (64 rows a fingerprint), and linked fingerprints share a key.
3. Of a key, the fingerprint that most documents have is its anchor. Members within reach of their anchor are linked to it,
   which makes one class of a group of copies with as many links as it has members.
4. Keys that still hold several classes are settled exactly: up to `LIMIT` members by comparing them all, more by cutting
   the key again, by variants of the bits it leaves open (halves of 16, then 8 ... bits), until every part is small. Equal keys
   fix all but a bit of what was cut, so five cuts leave 128 members at most and no part needs another way out.
5. Links give components; a component's name is its smallest doc_id.

No task gathers a key: they are counted by partial aggregates and looked up by joins that Spark splits where one is hot. Only the links
that join different classes are listed, never all pairs. Fingerprints and their variants are joined by shuffles and never pass through the driver.

Edge cases: a null text counts as empty, and all empty texts share fingerprint zero and are linked like any other; repeated
rows and equal doc_ids are allowed; a null doc_id counts as after all others and is returned as null; a text of any length is read whole, in
pieces; an empty table gives an empty result. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import shuffled, stored
from .components import components
from .textkit import pieces

WORDS = 3
SEED = 42
DISTANCE = 3
BITS = 64
LIMIT = 1024
"""Members of a key that are compared directly; a key of more is cut again."""
LAST = (1 << 63) - 1


def shingle_hashes(text: bytes, words: int = WORDS) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles, piece by piece."""
    held: list[bytes] = []
    whole = True
    for piece in pieces(text):
        held += piece.lower().split()
        if len(held) >= words:
            whole = False
            joined = map(b" ".join, zip(*(held[k:] for k in range(words))))
            yield np.fromiter(map(xxh64_intdigest, joined, repeat(SEED)), np.uint64, len(held) - words + 1)
            held = held[len(held) - words + 1 :]
    if whole and held:
        yield np.array([xxh64_intdigest(b" ".join(held), SEED)], dtype=np.uint64)


def fingerprint(text: bytes) -> int:
    ones, number = np.zeros(BITS, dtype=np.int64), 0
    for hashes in shingle_hashes(text):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        number += len(hashes)
    return int(np.packbits(2 * ones > number, bitorder="little").view("<u8")[0])


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(text.as_buffer().to_pybytes() if text.is_valid else b"") for text in batch.column("body")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(found.view(np.int64))], names=["doc", "mark"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, mark) per document: doc_id, `LAST` for null, and the fingerprint as a signed number."""
    own = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc"), F.col(text).cast("binary").alias("body"))
    return own.mapInArrow(_fingerprinted, "doc long, mark long")


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _variants(rows: DataFrame, width: int) -> DataFrame:
    """Each row once per bit of the `width` bits that its key leaves open, which begin at bit `low`.

    The new key fixes the half that holds the bit, without the bit; the other half stays open. A shared key of
    different parts only makes a part larger, for members are compared by their whole fingerprints.
    """
    half = width // 2
    out = rows.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    out = out.withColumns({"start": F.expr(f"low + (bit div {half}) * {half}").cast("int"), "wild": F.expr(f"bit % {half}").cast("int")})
    fixed = F.expr(f"shiftrightunsigned(mark, start) & {(1 << half) - 1}L & ~shiftleft(1L, wild)")
    rest = F.expr(f"low + (1 - bit div {half}) * {half}").cast("int")
    return out.select(F.xxhash64("key", "start", "wild", fixed).alias("key"), "mark", "n", "root", rest.alias("low"))


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between different classes, from rows (key, mark, root) sorted by key with at most LIMIT rows a key."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        key = held.column("key").to_numpy()
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        if len(cuts):
            yield _joined(held.slice(0, cuts[-1]))
            held = held.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield _joined(held)


def _joined(rows: pa.Table) -> pa.RecordBatch:
    """Compares all members of each key, neighbours first; lists a link only if it joins two classes that earlier ones left apart."""
    key, mark, root = (rows.column(name).to_numpy() for name in ("key", "mark", "root"))
    names, label = np.unique(root, return_inverse=True)
    up = np.arange(len(names))
    links = []

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for step in range(1, len(key)):
        same = key[step:] == key[:-step]
        if not same.any():
            break
        one, two = up[label[step:]], up[label[:-step]]
        near = np.flatnonzero(same & (one != two) & (np.bitwise_count(mark[step:].view(np.uint64) ^ mark[:-step].view(np.uint64)) <= DISTANCE))
        for a, b in np.unique(np.stack([one[near], two[near]], axis=1), axis=0).tolist():
            a, b = top(a), top(b)
            if a != b:
                up[max(a, b)] = min(a, b)
                links.append((names[a], names[b]))
        while len(near) and (up[up] != up).any():
            up = up[up]
    both = np.array(links, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])


def links(marks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) that make the classes of the different fingerprints (mark, n): n documents have a mark."""
    found, width = None, BITS
    rows = marks.select(F.lit(0).cast("long").alias("key"), "mark", "n", F.col("mark").alias("root"), F.lit(0).alias("low"))
    while True:
        rows = _variants(rows, width)
        keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("n", "mark", "root")).alias("anchor"))
        keys = keys.where("size > 1").select("key", "size", F.col("anchor.mark").alias("anchor"), F.col("anchor.root").alias("anchor_root"))
        live = stored(shuffled(rows).join(keys, "key"), "simhash-keys")
        near = live.where("root <> anchor_root").where(_distance("mark", "anchor") <= DISTANCE)
        near = stored(near.select(F.col("root").alias("a"), F.col("anchor_root").alias("b")).distinct(), "simhash-links")
        found = near if found is None else found.union(near)
        tops = components(near).select(F.col("node").alias("root"), F.col("root").alias("top"))
        live = shuffled(live).join(tops, "root", "left").select("key", "size", "mark", "n", F.coalesce("top", "root").alias("root"), "low")
        several = live.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
        live = stored(live.join(several, "key", "left_semi"), "simhash-open")
        width //= 2
        if width <= 2:  # the keys fix all but a few bits: parts are small whatever the limit
            limit = 1 << BITS // 8
        small = live.where(F.col("size") <= limit).select("key", "mark", "root")
        near = small.repartition("key").sortWithinPartitions("key", "mark").mapInArrow(_apart, "a long, b long")
        found = found.union(stored(near.distinct(), "simhash-links"))
        rows = live.where(F.col("size") > limit).select("key", "mark", "n", "root", "low")
        if rows.isEmpty():
            return found


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id of its component)."""
    own = stored(fingerprints(docs, doc_id, text), "fingerprints")
    marks = stored(own.groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("doc")), "fingerprint-owners")
    roots = components(links(marks)).select(F.col("node").alias("mark"), "root")
    rooted = stored(marks.join(roots, "mark", "left").select("mark", "doc", F.coalesce("root", "mark").alias("root")), "fingerprint-roots")
    named = shuffled(rooted).join(rooted.groupBy("root").agg(F.min("doc").alias("component")), "root").select("mark", "component")
    known = lambda column: F.when(F.col(column) != LAST, F.col(column))
    return shuffled(own).join(named, "mark").select(
        known("doc").alias(doc_id), F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), known("component").alias("component_id")
    )
