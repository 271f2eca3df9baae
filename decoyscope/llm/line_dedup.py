"""Line deduplication that returns keep bitmaps.

Each line is known by a 128-bit hash of its key (outer white space stripped, A-Z folded). Lines that a batch
already knows to repeat are settled where they are read; of every other hash a batch sends one document with its
line numbers. These rows are range-partitioned by hash and sorted by document and position inside a partition; one
streaming pass keeps the first document of every hash and reports the lines of the others. A hash that a third
of all documents hold meets as one row per batch of documents, not as one per line. Per document the result is a
zlib-compressed bit map over its lines, so texts move only when a caller applies the maps.

A line goes if its key has at least `LEAST` code points and a smaller doc_id has a line with that key. Edge
cases: a null or empty text is one empty line and keeps it; rows with the same doc_id are one document (none of
them takes a line from another), a null doc_id is one document after all others; equal rows get equal maps;
lines are split at line feeds only; an empty table gives an empty result. Only doc_id and text are read;
other columns do not matter, and `apply_bitmaps` keeps them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_key
from .textkit import NON_SPACE, chunks

LEAST = 10
LAST = (1 << 63) - 1
"""Stands for a null doc_id, after all others."""

_CANDIDATE = "h1 long, h2 long, doc long, row long, settled boolean, lines array<int>"


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc"), row_key(F.col(text)).alias("row"), F.col(text).alias("text"))


def _lines(batch: pa.RecordBatch, least: int) -> list[np.ndarray]:
    """Of a batch's lines with long enough keys: hashes, place of the document in the batch, line number."""
    parts = []
    for chunk in chunks(batch.column("text")):
        feeds = np.flatnonzero(chunk.data == 0x0A)
        begin = np.unique(np.concatenate((chunk.offsets[:-1], feeds + 1)))
        begin = begin[begin < len(chunk.data)]
        end = np.append(begin[1:], len(chunk.data))
        end = end - (chunk.data[end - 1] == 0x0A)
        starts, ends, _ = chunk.words(NON_SPACE)
        first, after = np.searchsorted(starts, begin), np.searchsorted(starts, end)
        full = after > first
        begin, low, high = begin[full], starts[first[full]], ends[after[full] - 1]
        points = chunk.code_points()
        long = points[high] - points[low] >= least
        begin, low, high = begin[long], low[long], high[long]
        text = np.searchsorted(chunk.offsets, begin, side="right") - 1
        number = np.searchsorted(feeds, begin) - np.searchsorted(feeds, chunk.offsets[text])
        hashes = [chunk.hasher(True, salt)(low, high).view(np.int64) for salt in (0, 1)]
        parts.append((*hashes, text + chunk.first, number))
    return [np.concatenate([part[k] for part in parts]) if parts else np.zeros(0, np.int64) for k in range(4)]


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal keys together (first key outermost), and where each group begins in it."""
    order = np.lexsort(keys[::-1])
    opens = np.zeros(len(order), dtype=bool)
    opens[:1] = True
    for key in keys:
        opens[1:] |= key[order][1:] != key[order][:-1]
    return order, np.flatnonzero(opens)


def _rows(h1, h2, doc, row, settled: bool, lines: np.ndarray, begins: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(lines)), pa.int32()), pa.array(lines, pa.int32()))
    return pa.RecordBatch.from_arrays(
        [pa.array(h1), pa.array(h2), pa.array(doc), pa.array(row), pa.array(np.full(len(begins), settled)), lists],
        names=["h1", "h2", "doc", "row", "settled", "lines"],
    )


def _candidates(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, place, number = _lines(batch, least)
            if not len(h1):
                continue
            docs, rows = batch.column("doc").to_numpy(), batch.column("row").to_numpy()
            order, begins = _groups(h1, h2, docs[place])
            hash_begins = np.zeros(len(begins), dtype=bool)
            hash_begins[:1] = True
            at = order[begins]
            hash_begins[1:] = (h1[at][1:] != h1[at][:-1]) | (h2[at][1:] != h2[at][:-1])
            sizes = np.diff(np.append(begins, len(order)))
            leads = np.repeat(hash_begins, sizes)  # lines in the batch's first document of their hash
            own, rest = order[leads], order[~leads]
            if len(own):
                part, cuts = _groups(h1[own], h2[own], docs[place[own]], rows[place[own]])
                own = own[part]
                head = own[cuts]
                yield _rows(h1[head], h2[head], docs[place[head]], rows[place[head]], False, number[own], cuts)
            if len(rest):
                part, cuts = _groups(docs[place[rest]], rows[place[rest]])
                rest = rest[part]
                head = place[rest[cuts]]
                yield _rows(rows[head], docs[head], docs[head], rows[head], True, number[rest], cuts)

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hash and document: those that are not of the first document of their hash."""
    last: tuple[int, int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc = (batch.column(name).to_numpy() for name in ("h1", "h2", "doc"))
        settled = batch.column("settled").to_numpy(zero_copy_only=False)
        opens = np.ones(len(h1), dtype=bool)
        opens[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (settled[1:] != settled[:-1])
        opens[0] = settled[0] or last is None or (h1[0], h2[0]) != last[:2]
        run = np.cumsum(opens)
        firsts = np.concatenate(([last[2] if last else 0], doc[opens]))[run]
        if not settled[-1]:
            last = (h1[-1], h2[-1], firsts[-1])
        kept = batch.filter(pa.array(settled | (doc != firsts)))
        if kept.num_rows:
            yield pa.RecordBatch.from_arrays([kept.column(name) for name in ("doc", "row", "lines")], names=["doc", "row", "lines"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps, dropped = [], []
        sizes = batch.column("n_lines").to_pylist()
        for size, lines in zip(sizes, batch.column("lines").to_pylist()):
            keep = np.ones(size, dtype=bool)
            if lines:
                keep[lines] = False
            dropped.append(int(size - keep.sum()))
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1) if dropped[-1] else None)
        names = ["doc", "row", "n_lines", "n_dropped", "keep"]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("row"), pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())], names=names
        )


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """One row per different (doc, row): n_lines, n_dropped and `keep`, the compressed bits of kept lines (null: all kept).

    `doc` is doc_id (`LAST` for null) and `row` the text's hash, which together name the map of a document's row.
    """
    keyed = _keyed(docs, doc_id, text)
    order = ("h1", "h2", "settled", "doc", "row")
    dropped = (
        keyed.mapInArrow(_candidates(least), _CANDIDATE).repartitionByRange("h1", "h2").sortWithinPartitions(*order)
        .mapInArrow(_later, "doc long, row long, lines array<int>")
        .groupBy("doc", "row").agg(F.flatten(F.collect_list("lines")).alias("lines"))
    )
    sizes = keyed.groupBy("doc", "row").agg(F.max(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))).alias("feeds"))
    sizes = sizes.select("doc", "row", (F.coalesce("feeds", F.lit(0)) + 1).cast("int").alias("n_lines"))
    return sizes.join(dropped, ["doc", "row"], "left").mapInArrow(_pack, "doc long, row long, n_lines long, n_dropped long, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with `text` cut down to its kept lines, and n_lines and n_dropped added (replaced if there)."""
    own = docs.drop("n_lines", "n_dropped")
    keyed = own.withColumns({
        "_doc": F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)), "_row": row_key(F.col(text)), text: F.coalesce(F.col(text), F.lit("")),
    })
    named = bitmaps.select(F.col("doc").alias("_doc"), F.col("row").alias("_row"), "n_lines", "n_dropped", F.col("keep").alias("_keep"))
    joined = keyed.join(named, ["_doc", "_row"], "left").select(*own.columns, "n_lines", "n_dropped", "_keep")
    schema = T.StructType(joined.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text)
            maps = batch.column("_keep")
            if maps.null_count < len(maps):
                values = texts.to_pylist()
                for k, packed in enumerate(maps.to_pylist()):
                    if packed is not None:
                        lines = values[k].split("\n")
                        bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), dtype=np.uint8), count=len(lines))
                        values[k] = "\n".join(line for line, keep in zip(lines, bits.tolist()) if keep)
                texts = pa.array(values, pa.string())
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([texts if name == text else batch.column(name) for name in names], names=names)

    return joined.mapInArrow(run, schema)
