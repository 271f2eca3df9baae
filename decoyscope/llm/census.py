"""How often hashed items (shingles, n-grams) occur in the whole corpus, told to every block of documents.

Documents are dealt into blocks of a few megabytes by a hash. A block counts its own items once, sorts the hashes
and sends them, cut by hash range, to the table's buckets: one row per block and bucket, differences of sorted
hashes instead of hashes. A bucket adds up the counts of all blocks and answers every block in the block's own
order, so answers need no keys. An item that half the corpus holds is one entry per block; buckets are ranges of
uniform hashes. Blocks and buckets have a size, their numbers grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20
BUCKET_ITEMS = 1 << 20

Counted = Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]
"""A block's different item hashes in order, and their counts."""


def dealt(docs: DataFrame, size: int, *keys: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows with a `block` number; `size` is the texts' total in bytes."""
    return docs.withColumn("block", F.pmod(F.xxhash64(*keys), F.lit(max(1, -(-size // block_bytes)))).cast("int"))


def packed(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: high planes of small numbers vanish."""
    return pa.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, size).T).view("<u8").reshape(-1)


def _sent(count: Counted, bits: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        keys, counts = count(rows)
        own = rows.column("block")[0].as_py()
        cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.int64)
        cuts = np.concatenate(([0], cuts, [len(keys)])).tolist()
        out = {"bucket": [], "block": [], "size": [], "keys": [], "counts": []}
        for bucket, (low, high) in enumerate(zip(cuts, cuts[1:])):
            if high > low:
                steps = np.diff(keys[low:high], prepend=np.uint64(0))
                for name, value in zip(out, (bucket, own, high - low, packed(steps), packed(counts[low:high]))):
                    out[name].append(value)
        return pa.table(out, schema=_SENT)

    return run


_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("size", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_TOLD = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("size", pa.int32()), ("answer", pa.binary())])


def _told(answer: Callable[[np.ndarray], np.ndarray]) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        sizes = rows.column("size").to_numpy()
        keys = np.concatenate([np.cumsum(unpacked(data.as_py(), size), dtype=np.uint64) for data, size in zip(rows.column("keys"), sizes)])
        counts = np.concatenate([unpacked(data.as_py(), size) for data, size in zip(rows.column("counts"), sizes)])
        order = np.argsort(keys, kind="stable")
        opens = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
        totals = np.add.reduceat(counts[order], opens)
        entries = np.empty(len(keys), dtype=np.uint64)
        entries[order] = np.repeat(totals, np.diff(np.append(opens, len(keys))))
        ends = np.cumsum(sizes)
        answers = [packed(answer(entries[end - size : end])) for size, end in zip(sizes, ends)]
        return pa.table([rows.column("block"), rows.column("bucket"), rows.column("size"), pa.array(answers, pa.binary())], schema=_TOLD)

    return run


def corpus_counts(blocks: DataFrame, count: Counted, items: int, answer: Callable[[np.ndarray], np.ndarray] = lambda totals: totals) -> DataFrame:
    """Rows (block, bucket, size, answer): `answer` of the corpus totals of a block's items, in the block's order.

    `items` is the expected number of entries over all blocks; it sets the number of buckets.
    """
    bits = max(0, (max(1, items // BUCKET_ITEMS) - 1).bit_length())
    sent = blocks.groupBy("block").applyInArrow(_sent(count, bits), "bucket int, block int, size int, keys binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(_told(answer), "block int, bucket int, size int, answer binary")


def answers(rows: pa.Table) -> np.ndarray:
    """A block's answers, put together in the order of its items."""
    rows = rows.sort_by("bucket")
    parts = [unpacked(data.as_py(), size.as_py()) for data, size in zip(rows.column("answer"), rows.column("size"))]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def places(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Each key's place among the different keys in order, and their number; one sort instead of a search per key."""
    order = np.argsort(keys)
    new = np.zeros(len(keys), dtype=bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    rank = np.cumsum(new)
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = rank
    return out, int(rank[-1]) + 1 if len(keys) else 0
