"""Sharding by extendible hashing, in SQL functions only.

A document's hash is read from its first bit on; a shard is a bit prefix. A prefix whose documents exceed the byte
limit is split on one more bit, all others stay whole, so neighbouring shards can have different depths. All splits
are decided from sums over directory cells (prefixes a few bits finer than the average shard), not over documents;
only cells that are still too large are looked at again, with more bits. Documents find their shard by an equality
join on their cell, whose keys are uniform hash bits.

Edge cases: a null text has 0 bytes; a null doc_id is hashed as an empty one with its text, so many null ids still
spread; a document larger than the limit, or rows equal in doc_id and text, cannot be split: they get a shard of
their own, marked `oversized`; an empty table gives an empty result. Columns of the input named like the added ones
(`shard`, `depth`, `bytes`, `shard_bytes`, `oversized`) are replaced.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BITS = 60
SHARD_BYTES = 1 << 20
FINER = 3
"""Bits by which directory cells are finer than the average shard."""
DEEPER = 8

ADDED = ("shard", "depth", "bytes", "shard_bytes", "oversized")


def content_bits(doc_id: Column, text: Column) -> Column:
    """60 hash bits of a row's identity, as a long; SQL engines with md5 agree on it."""
    named = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")


def _prefix(bits: Column, depth: Column | int) -> Column:
    return F.shiftright(bits, F.lit(BITS) - depth) if isinstance(depth, Column) else F.shiftright(bits, BITS - depth)


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("bytes").alias("bytes"), F.min("low").alias("low"), F.max("high").alias("high"))


def _leaves(cells: DataFrame, known: int, fine: int, limit: int) -> DataFrame:
    """For each cell of `fine` bits: depth and bytes of the shallowest prefix deeper than `known` that is small enough."""
    depths = F.explode(F.sequence(F.lit(known + 1), F.lit(fine)))
    under = cells.select("cell", "bytes", "low", "high", depths.alias("depth"))
    under = under.withColumn("prefix", F.expr(f"shiftright(cell, {fine} - depth)"))
    small = _sums(under, "depth", "prefix").where((F.col("bytes") <= limit) | (F.col("low") == F.col("high")))
    found = under.select("cell", "depth", "prefix").join(small.select("depth", "prefix", F.col("bytes").alias("shard_bytes")), ["depth", "prefix"])
    return found.groupBy("cell").agg(F.min(F.struct("depth", "shard_bytes")).alias("leaf"))


def directory(keys: DataFrame, limit: int = SHARD_BYTES) -> list[tuple[int, DataFrame]]:
    """Directory levels as (bits, table of cell -> depth, shard_bytes); `keys` has columns bits and bytes.

    A level covers the cells that the levels before it left too large. Few levels are needed: the first resolves
    all prefixes up to `FINER` bits beyond the average depth.
    """
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    known, fine = -1, max(0, min(BITS, ceil(log2(max(1, total / limit))) + FINER))
    open_keys, levels = keys, []
    while True:
        rows = open_keys.select(_prefix(F.col("bits"), fine).alias("cell"), "bytes", F.col("bits").alias("low"), F.col("bits").alias("high"))
        cells = stored(_sums(rows, "cell"), "shard-cells")
        leaves = stored(cells.select("cell").join(_leaves(cells, known, fine, limit), "cell", "left"), "shard-directory")
        levels.append((fine, leaves.where("leaf is not null").select("cell", "leaf.depth", "leaf.shard_bytes")))
        large = leaves.where("leaf is null").select("cell")
        if large.isEmpty():
            return levels
        open_keys = stored(open_keys.join(large, _prefix(F.col("bits"), fine) == F.col("cell"), "left_semi"), "shard-open")
        known, fine = fine, min(BITS, fine + DEEPER)


def shard(docs: DataFrame, limit: int = SHARD_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their shard (its bit prefix), the shard's depth and bytes, and their own bytes."""
    own = docs.drop(*ADDED)
    rows = own.withColumns({"_bits": content_bits(F.col(doc_id), F.col(text)), "bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long")})
    levels = directory(stored(rows.select(F.col("_bits").alias("bits"), "bytes"), "shard-keys"), limit)
    for k, (fine, leaves) in enumerate(levels):
        named = leaves.select(F.col("cell").alias(f"_cell{k}"), F.col("depth").alias(f"_depth{k}"), F.col("shard_bytes").alias(f"_bytes{k}"))
        rows = rows.join(named, _prefix(F.col("_bits"), fine) == F.col(f"_cell{k}"), "left")
    depth = F.coalesce(*(F.col(f"_depth{k}") for k in range(len(levels))))
    size = F.coalesce(*(F.col(f"_bytes{k}") for k in range(len(levels))))
    rows = rows.select(*own.columns, "_bits", "bytes", depth.alias("depth"), size.alias("shard_bytes"))
    name = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr(f"lpad(bin(shiftright(_bits, {BITS} - depth)), depth, '0')"))
    return rows.select(*own.columns, name.alias("shard"), "depth", "bytes", "shard_bytes", (F.col("shard_bytes") > limit).alias("oversized"))
