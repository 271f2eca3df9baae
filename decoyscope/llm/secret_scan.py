"""Secret scans judged by corpus-wide ownership frequency, in SQL functions only.

Patterns give candidates: three base kinds that are always reported, and opaque mixed strings that may be
secrets. Values are counted over the whole corpus by distinct repositories (documents) and distinct owners
(sources), in three steps that each combine before they shuffle. A value that many owners hold is a copied example, and so is one
that two owners hold in many repositories; a value of a single owner looks live in however many of its repositories it is. Opaque strings are reported, as
kind `owned`, only if they look live; base spans keep their place and get the same judgement.

Positions come from the text between matches: a match starts after all pieces and matches before it. Offsets
are code points. Edge cases: a null text is empty and has no spans; rows equal in all that is read count once
and each get the result; a null owner is an owner of its own, a null doc_id a repository of its own; an empty
table gives an empty result. Only doc_id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import row_key, stored

MIN_ASSIGNED = 6
MAX_OWNERS, MAX_REPOSITORIES = 2, 5
"""A value of more owners, or of several owners and in more documents, is a copied example."""

KINDS = ("assign", "access", "hex", "owned")


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = (
    "(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
OPAQUE = "[A-Za-z0-9+/_-]{20,}"
"""Fixed patterns. The counted forms find the same as `+` with a length test after it, as they are whole runs."""

_PATTERNS = {"assign": (ASSIGN, 2), "access": (ACCESS, 0), "hex": (HEX, 0), "owned": (OPAQUE, 0)}


def _passes(kind: Column, value: Column) -> Column:
    mixed = value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
    return F.when(kind == "assign", F.length(value) >= MIN_ASSIGNED).when(kind == "owned", mixed).otherwise(F.lit(True))


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """Different (doc_id, row, owner, kind, start, end, value): all matches that pass; `row` is a hash of text and owner."""
    body = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(owner).cast("string").alias("owner"), row_key(F.col(text), F.col(owner)).alias("row"), body.alias("text"))
    found = []
    for kind, (pattern, group) in _PATTERNS.items():
        whole = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        value = F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if group else whole
        wanted = F.exists(whole, lambda v: _passes(F.lit("owned"), v)) if kind == "owned" else F.col("text").rlike(pattern)
        parts = F.struct(F.lit(kind).alias("kind"), F.arrays_zip(F.split("text", pattern, -1).alias("piece"), whole.alias("whole"), value.alias("value")).alias("parts"))
        found.append(F.when(wanted, parts))
    kinds = own.select("doc_id", "owner", "row", F.monotonically_increasing_id().alias("at"), F.explode(F.array(*found)).alias("f")).where(F.col("f").isNotNull())
    parts = kinds.select("doc_id", "owner", "row", "at", "f.kind", F.posexplode("f.parts").alias("pos", "part"))
    before = W.partitionBy("at", "kind").orderBy("pos")
    start = F.sum(F.length("part.piece")).over(before) + F.coalesce(F.sum(F.length("part.whole")).over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = parts.select("doc_id", "owner", "row", "kind", "pos", start.alias("start"), F.length("part.whole").alias("size"), F.col("part.value").alias("value"))
    passed = placed.where(F.col("value").isNotNull() & _passes(F.col("kind"), F.col("value")))
    return passed.select("doc_id", "owner", "row", "kind", "start", (F.col("start") + F.col("size")).alias("end"), F.md5("value").alias("value")).distinct()


def ownership(found: DataFrame) -> DataFrame:
    """By value: distinct repositories and owners over the corpus, and whether that makes it a copied example."""
    held = found.select("value", "owner", "doc_id").distinct()
    by_owner = held.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("held"))
    counted = by_owner.groupBy("value").agg(F.sum("held").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))
    shared = (F.col("n_owners") > 1) & (F.col("n_repositories") > MAX_REPOSITORIES)
    return counted.withColumn("copied", (F.col("n_owners") > MAX_OWNERS) | shared)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """Per document row: base counts and spans, all spans, and how many look live. Also `row`, the hash of text and owner."""
    found = stored(candidates(docs, doc_id, text, owner), "secret-candidates")
    judged = found.join(ownership(found), "value").where((F.col("kind") != "owned") | ~F.col("copied"))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct("start", order.alias("order"), "kind", "end", "copied")
    listed = judged.groupBy(F.col("doc_id").alias("_doc"), F.col("row").alias("_row")).agg(F.sort_array(F.collect_list(span)).alias("found"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(text), F.col(owner)).alias("row"))
    joined = rows.join(listed, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row")), "left")
    all_found = F.coalesce("found", F.array().cast(listed.schema["found"].dataType))
    base = F.filter(all_found, lambda s: s["kind"] != "owned")
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter(all_found, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return joined.select(
        "doc_id", "row", *map(number, KINDS[:3]), written(base).alias("base"), written(all_found).alias("spans"),
        F.size(F.filter(all_found, lambda s: ~s["copied"])).cast("long").alias("n_live"),
        F.size(F.filter(all_found, lambda s: s["copied"])).cast("long").alias("n_copied"),
    )
