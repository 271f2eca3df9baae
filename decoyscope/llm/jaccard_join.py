"""Exact Jaccard join of documents on word shingles, as classes of linked documents.

1. Documents are dealt into blocks; a census of their shingles (see `census`) tells every block how many documents
   hold each. Documents of equal shingle sets are one from here on, known by a fingerprint of the set.
2. Of each set's shingles, rarest first, the first 25 % + 1 are enough: two linked sets share one of them. Those that
   only this document holds are dropped, so most documents send nothing further.
3. Rows (shingle, size, set) are sorted by shingle and size. Neighbours in a run are tried first, which joins groups
   of copies with as many pairs as they have members; verified links give first classes.
4. Runs that still hold different classes become tiles. A run of more than `TILE` sets is cut by size: in bands of ratio 4 to 3, so
   that a set can only be linked inside its band and with the two next to it, and inside a band by a hash if that is still too
   large. Sorted by size, a set meets the sizes it can be linked with, by bitmaps of hashed shingles: with d bits
   different the overlap is at most (|x| + |y| - d) / 2. Two sets that share several runs are listed in that of their smallest
   common key; a row brings its set's `LEAST` smallest keys to tell, and where these have none in common the pair is listed
   in each. Of the pairs of two classes that the bound lets through, the likeliest few are verified first, for one link is enough to join two
   classes; more rounds follow until every pair of different classes that passes the bound has been verified.
5. Verification intersects the sorted hash arrays. All links together give the classes.

No pair that could join two classes is left out, and no pairs inside a class are listed. Linked: 100 * |x and y| >=
75 * |x or y|. Edge cases: a text of fewer than five words is one shingle; a null or empty text, or one without words,
has none and is linked with nothing, so its class is its own doc_id; repeated rows and equal doc_ids are allowed; a null
doc_id counts as after all others and is returned as null; an empty table gives an empty result. Only doc_id and text
are read. Shingles are known by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .census import answers, corpus_counts, dealt, places
from .common import row_key, stored, text_bytes
from .components import components
from .textkit import NON_SPACE, chunks, mix, windows, within

WORDS = 5
SIMILARITY = 75
"""Per cent of the union that a link's intersection has at least."""
BITMAP = 2048
BLOCK_BYTES = 4 << 20
CENSUS = np.uint64(((1 << 64) - 1) ^ 0xFFFF)
"""Bits of a shingle's hash that the census counts by; a shared key only makes a shingle look more common than it is."""
TILE = 2048
"""Sets that a tile's part has; a run of more is cut."""
LEAST = 32
"""Smallest prefix keys of a set that its rows bring along."""
BAND = 4 / 3
"""Linked sets differ in size by this ratio at most, so they are in the same band or in neighbouring ones."""
FIRST_PAIRS = 8
"""Candidate pairs of two classes that are tried first; the next rounds try 16 times as many, until none is left."""
LAST = (1 << 63) - 1

_SETS = pa.schema([
    ("doc", pa.int64()), ("row", pa.int64()), ("n", pa.int32()), ("set", pa.int64()), ("block", pa.int32()), ("keys", pa.list_(pa.int64())), ("bitmap", pa.binary()),
    ("shingles", pa.binary()),
])
_SETS_DDL = "doc long, row long, n int, set long, block int, keys array<long>, bitmap binary, shingles binary"


def shingle_sets(texts: pa.Array, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each text's different shingle hashes in order, laid end to end, and their numbers."""
    sets, sizes = [], []
    for chunk in chunks(texts):
        starts, ends, counts = chunk.words(NON_SPACE)
        hashes = chunk.hasher(fold=True)(starts, ends)
        found, number = windows(hashes, counts, width)
        text = np.repeat(np.arange(len(chunk)), number)
        for fewer in range(1, width):  # texts of fewer words: the whole sequence is one shingle
            short = np.flatnonzero(counts == fewer)
            if len(short):
                begin = (np.cumsum(counts) - counts)[short]
                own = np.concatenate([hashes[k : k + fewer] for k in begin])
                text = np.concatenate((text, short))
                found = np.concatenate((found, windows(own, np.full(len(short), fewer), fewer)[0]))
        order = np.lexsort((found, text))
        found, text = found[order], text[order]
        new = np.ones(len(found), dtype=bool)
        new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
        sets.append(found[new])
        sizes.append(np.bincount(text[new], minlength=len(chunk)))
    if not sets:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(sets), np.concatenate(sizes)


def _fingerprints(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(shingles) + 1, dtype=np.uint64)
    np.cumsum(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
    ends = np.cumsum(sizes)
    return mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)).view(np.int64)


def _block(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's rows by doc, their sets and fingerprints, and which rows are the first of their set."""
    rows = rows.combine_chunks().sort_by("doc")
    shingles, sizes = shingle_sets(rows.column("text").combine_chunks())
    marks = _fingerprints(shingles, sizes)
    first = np.zeros(len(marks), dtype=bool)
    first[np.unique(marks, return_index=True)[1]] = True
    return rows, shingles, sizes, marks, first & (sizes > 0)


def _count(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    _, shingles, sizes, _, first = _block(rows)
    return np.unique(shingles[np.repeat(first, sizes)] & CENSUS, return_counts=True)


def _rarity(totals: np.ndarray) -> np.ndarray:
    """A class that grows with the number of documents; 0 for one document."""
    return np.minimum(np.where(totals <= 64, totals - 1, 64 + 8 * np.log2(np.maximum(totals, 64) / 64)), 255).astype(np.uint64)


def _bitmaps(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    bits = np.zeros((len(sizes), BITMAP), dtype=bool)
    bits[np.repeat(np.arange(len(sizes)), sizes), (shingles & np.uint64(BITMAP - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def _prefixes(rows: pa.Table, told: pa.Table) -> pa.Table:
    """One row per document; sets that share a prefix shingle with another document bring keys, bitmap and shingles."""
    if not rows.num_rows:
        return _SETS.empty_table()
    rows, shingles, sizes, marks, first = _block(rows)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    led = first[owner]
    counted = shingles[led] & CENSUS
    rarity = np.zeros(len(shingles), dtype=np.int64)
    rarity[led] = answers(told)[places(counted)[0]]
    order = np.argsort(owner * 256 + rarity, kind="stable")
    place = np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]
    length = sizes - -(-SIMILARITY * sizes // 100) + 1
    sent = order[led & (rarity[order] > 0) & (place < length[owner])]
    number = np.bincount(owner[sent], minlength=len(sizes))
    ends = np.cumsum(sizes)
    own = np.flatnonzero(number)
    bitmap: list[bytes | None] = [None] * len(sizes)
    body: list[bytes | None] = [None] * len(sizes)
    for low in range(0, len(own), 4096):
        some = own[low : low + 4096]
        maps = _bitmaps(np.concatenate([shingles[ends[k] - sizes[k] : ends[k]] for k in some]), sizes[some])
        for k, bits in zip(some.tolist(), maps):
            bitmap[k], body[k] = bits.tobytes(), shingles[ends[k] - sizes[k] : ends[k]].tobytes()
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(number))), pa.int32()), pa.array(shingles[sent].view(np.int64)))
    return pa.table(
        [rows.column("doc"), rows.column("row"), pa.array(sizes, pa.int32()), pa.array(marks), rows.column("block"), lists, pa.array(bitmap, pa.binary()), pa.array(body, pa.binary())],
        schema=_SETS,
    )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of sets that follow one another in a run and whose sizes allow a link."""
    last: tuple[int, int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, n, mark = (batch.column(name).to_numpy() for name in ("key", "n", "set"))
        if last is not None:
            key, n, mark = (np.concatenate(([value], column)) for value, column in zip(last, (key, n, mark)))
        last = (key[-1], n[-1], mark[-1])
        pair = (key[1:] == key[:-1]) & (mark[1:] != mark[:-1]) & (100 * n[:-1].astype(np.int64) >= SIMILARITY * n[1:].astype(np.int64))
        if pair.any():
            a, b = mark[:-1][pair], mark[1:][pair]
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])


def _tiles(most: int):
    """Candidate pairs (a, b) by tile, at most the `most` likeliest of two classes; `more` tells that there are others.

    Rows come sorted by tile and size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            key, low, high = (held.column(name).to_numpy() for name in ("key", "low", "high"))
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            if len(cuts):
                yield from _tile_pairs(held.slice(0, cuts[-1]), np.concatenate(([0], cuts)), most)
                held = held.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield from _tile_pairs(held, np.array([0, held.num_rows]), most)

    return run


def _tile_pairs(rows: pa.Table, cuts: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    low, high, part, n, mark, root, run = (rows.column(name).to_numpy() for name in ("low", "high", "part", "n", "set", "root", "key"))
    bits = np.frombuffer(b"".join(rows.column("bitmap").to_pylist()), dtype=np.uint64).reshape(-1, BITMAP // 64)
    lists = rows.column("least").combine_chunks()
    least = np.zeros((len(n), LEAST), dtype=np.int64)
    held = np.diff(lists.offsets.to_numpy())
    least[:] = np.arange(len(n))[:, None]  # fills short rows; a row's own number is compared with no other's
    filled = np.arange(LEAST) < held[:, None]
    least[filled] = lists.flatten().to_numpy()
    for begin, end in zip(cuts, cuts[1:]):
        tile = [column[begin:end] for column in (n.astype(np.int64), root, bits, part, least, filled)]
        pairs, more = _compared(*tile, run=run[begin], across=low[begin] != high[begin], most=most)
        if len(pairs):
            a, b = mark[begin:end][pairs[:, 0]], mark[begin:end][pairs[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(more)], names=["a", "b", "more"])


def _first_in(run: int, keys: np.ndarray, filled: np.ndarray, own: np.ndarray, own_filled: np.ndarray) -> np.ndarray:
    """Of rows of sorted keys: which have no common key with `own` that is smaller than the run's."""
    smaller = own[own_filled & (own < run)]
    if not len(smaller):
        return np.ones(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(smaller, keys), len(smaller) - 1)
    return ~((smaller[at] == keys) & filled).any(axis=1)


def _compared(
    n: np.ndarray, root: np.ndarray, bits: np.ndarray, part: np.ndarray, least: np.ndarray, filled: np.ndarray, run: int, across: bool, most: int
) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by size: places of pairs of different classes that can be linked, and whether their classes have more."""
    found = []
    for k in range(len(n) - 1):
        end = int(np.searchsorted(n, 100 * n[k] // SIMILARITY, side="right"))
        wanted = root[k + 1 : end] != root[k]
        if across:  # both parts meet here; pairs inside a part meet in a tile of their own
            wanted &= part[k + 1 : end] != part[k]
        at = np.flatnonzero(wanted) + k + 1
        if len(at):
            apart = np.bitwise_count(bits[at] ^ bits[k]).sum(axis=1, dtype=np.int64)
            both = n[k] + n[at]
            fits = (100 + SIMILARITY) * ((both - apart) // 2) >= SIMILARITY * both
            at, apart = at[fits], apart[fits]
            first = _first_in(run, least[at], filled[at], least[k], filled[k])
            if first.any():
                found.append(np.stack([np.full(first.sum(), k), at[first], apart[first]], axis=1))
    if not found:
        return np.zeros((0, 2), dtype=np.int64), np.zeros(0, dtype=bool)
    pairs = np.concatenate(found)
    one, two = root[pairs[:, 0]], root[pairs[:, 1]]
    order = np.lexsort((pairs[:, 2], np.maximum(one, two), np.minimum(one, two)))
    pairs, one, two = pairs[order], np.minimum(one, two)[order], np.maximum(one, two)[order]
    opens = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
    group = np.cumsum(opens) - 1
    place = np.arange(len(group)) - np.flatnonzero(opens)[group]
    kept = place < most
    return pairs[kept, :2], (np.bincount(group) > most)[group[kept]]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            x, y = (np.frombuffer(side.as_buffer(), dtype=np.uint64) for side in (x, y))
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            common = int(np.count_nonzero(y[at] == x))
            linked.append(100 * common >= SIMILARITY * (len(x) + len(y) - common))
        kept = batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))
        if kept.num_rows:
            yield kept


def _tile_rows(rows: DataFrame, roots: DataFrame, bodies: DataFrame) -> DataFrame:
    """The sets of runs that hold more than one class, with their bitmaps, dealt into tiles and sorted.

    Runs of the same sets are taken once. A run over TILE sets is cut in bands of sizes, and a band over TILE sets in parts.
    """
    rooted = rows.join(roots.withColumnRenamed("node", "set"), "set", "left").select("key", "n", "set", F.coalesce("root", "set").alias("root"))
    runs = rooted.groupBy("key").agg(
        F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("set")).alias("members"),
        F.min("set").alias("first"),
    )
    runs = runs.where("least <> most").groupBy("size", "members", "first").agg(F.min("key").alias("key"))
    rooted = rooted.join(runs.select("key", (F.col("size") > TILE).alias("long")), "key")
    rooted = rooted.withColumn("band", F.when(F.col("long"), F.floor(F.log("n") / math.log(BAND))).otherwise(0).cast("int"))
    bands = rooted.where("long").groupBy("key", "band").count().select("key", "band", F.ceil(F.col("count") / TILE).cast("int").alias("parts"))
    bands = bands.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("band", "parts"))).alias("parts"))  # a band per ratio of sizes: some dozens
    cut = rooted.join(bands, "key", "left")
    number = lambda band: F.coalesce(F.try_element_at("parts", band), F.lit(0))
    cell = lambda band, part: band * F.lit(1 << 32) + part
    cells = lambda band: F.transform(F.sequence(F.lit(0), F.greatest(number(band), F.lit(1)) - 1), lambda part: cell(band, part))
    there = lambda band: F.when(number(band) > 0, cells(band)).otherwise(F.array().cast("array<bigint>"))
    own = F.when(F.col("long"), cell(F.col("band"), F.pmod(F.xxhash64("set"), number(F.col("band"))))).otherwise(F.lit(0)).cast("bigint")
    cut = cut.withColumn("part", own)
    others = F.concat(there(F.col("band") - 1), there(F.col("band")), there(F.col("band") + 1))
    cut = cut.withColumn("other", F.explode(F.when(F.col("long"), others).otherwise(F.array(F.lit(0).cast("bigint")))))
    cut = cut.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "n", "set", "root")
    brought = bodies.select("set", "bitmap", F.slice(F.sort_array("keys"), 1, LEAST).alias("least"))
    return cut.join(brought, "set").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "n", "set")


def _links(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Of different pairs: those that are linked."""
    x = bodies.select(F.col("set").alias("a"), F.col("shingles").alias("x"))
    y = bodies.select(F.col("set").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long")


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.withColumns({"doc": F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)), "row": row_key(F.col(text))})


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc (`LAST` for null), row (hash of the text), n, and of its class the smallest doc and that document's row."""
    own = _named(docs.select(doc_id, text), doc_id, text).select("doc", "row", F.col(text).alias("text"))
    size = text_bytes(own)
    blocks = dealt(own, size, F.col("doc"), F.col("row"), block_bytes=BLOCK_BYTES)
    told = corpus_counts(blocks, _count, size // 6, _rarity)
    sets = stored(blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_prefixes, _SETS_DDL), "shingle-sets")

    owners = sets.where("n > 0").groupBy("set").agg(F.min(F.struct("doc", "row", "block")).alias("owner"))
    owners = stored(owners.select("set", "owner.doc", "owner.row", "owner.block"), "set-owners")
    shared = sets.where("shingles is not null").select("set", "n", "block", "keys", "bitmap", "shingles")
    bodies = stored(shared.join(owners.select("set", "block"), ["set", "block"], "left_semi"), "set-bodies")
    rows = bodies.select("set", "n", F.explode("keys").alias("key"))

    pairs = rows.repartition("key").sortWithinPartitions("key", "n", "set").mapInArrow(_neighbours, "a long, b long")
    final = components(stored(_links(pairs.distinct(), bodies), "neighbour-links"))
    tested, most = None, FIRST_PAIRS
    while True:
        tiles = _tile_rows(rows, final, bodies).mapInArrow(_tiles(most), "a long, b long, more boolean")
        tried = stored(tiles.groupBy("a", "b").agg(F.max("more").alias("more")), "tile-pairs")
        fresh = tried.select("a", "b") if tested is None else tried.select("a", "b").join(tested, ["a", "b"], "left_anti")
        links = stored(_links(fresh, bodies), "tile-links")
        if not links.isEmpty():
            final = components(links.union(final.select("node", "root")))
        if tried.where("more").isEmpty():
            break
        tested = tried.select("a", "b") if tested is None else tested.union(tried.select("a", "b")).distinct()
        most *= 16

    least = owners.join(final.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    named = least.groupBy("root").agg(F.min(F.struct("doc", "row")).alias("class"))
    of_set = least.select("set", "root").join(named, "root").select("set", "class")
    found = sets.select("doc", "row", "n", "set").join(of_set, "set", "left")
    return found.select("doc", "row", "n", F.coalesce("class.doc", "doc").alias("class_doc"), F.coalesce("class.row", "row").alias("class_row"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id of its class)."""
    known = lambda column: F.when(F.col(column) != LAST, F.col(column))
    return grouped(docs, doc_id, text).select(
        known("doc").alias(doc_id), F.col("n").cast("long").alias("n_shingles"), known("class_doc").alias("component_id")
    )


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, columns unchanged, with one row of each class: that of its smallest doc_id."""
    found = stored(grouped(docs, doc_id, text), "classes")
    by_name = ["doc", "row"]
    gone = found.where("doc <> class_doc or row <> class_row").select(*by_name).distinct()
    kept = _named(docs, doc_id, text).join(gone, by_name, "left_anti")
    repeated = stored(found.groupBy(*by_name).count().where("count > 1").select(*by_name), "repeated")
    if not repeated.isEmpty():
        once = kept.join(repeated, by_name, "left_semi").dropDuplicates(by_name)
        kept = kept.join(repeated, by_name, "left_anti").unionByName(once)
    return kept.select(docs.columns)
