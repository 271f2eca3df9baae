"""Mixing to target weights by iterative proportional fitting, in SQL functions only.

Token counts of (source, language, topic) cells are raked: for each of the three in turn, every value's cells are
scaled so that the value's share meets its target, again and again until no share needs more than `TOLERANCE`.
Targets that the cells cannot meet together are reported by a warning with what is missing. A cell's fitted weight over its tokens, divided
by the largest such ratio, is the probability with which its documents are kept, so expected token shares are the
fitted ones. A document is kept if a uniform hash of it falls below its probability: the same documents every run.

Fitting works on the cell table alone, one row per combination that occurs, by grouped sums and joins, and cuts its
lineage after every step. Documents are only aggregated to cells and joined with them; Spark broadcasts the cell
table when it is small and splits hot cells of the join when it is not.

Targets default to token shares raised to `TEMPER` (which raises rare values) for each of the three. Edge cases: a
null or empty text weighs one token; null values of source or language are the value ''; values without a target
keep their own token share before all are scaled to 1; a value that no document has is left out; an empty table
gives an empty result. Columns of the input named like the added ones (`topic`, `tokens`, `probability`, `kept`)
are replaced.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .sharding import BITS, content_bits

TEMPER = 0.8
SWEEPS = 20
"""Sweeps made before raking may give up; the SQL makes as many. Raking ends earlier once it has converged."""
TOLERANCE = 1e-8
"""Raking has converged when no margin of a sweep needs a larger relative correction."""
MAX_SWEEPS = 1000
PATIENCE, STALLED = 10, 0.9
"""After SWEEPS, raking gives up if PATIENCE sweeps leave more than this part of the error: targets contradict each other."""
DIMENSIONS = ("source", "lang", "topic")
ADDED = ("topic", "tokens", "probability", "kept")


def words(text: Column) -> Column:
    """Words of the text, at least one."""
    return F.greatest(F.size(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+")), F.lit(1)).cast("long")


def form_topic(text: Column, tokens: Column) -> Column:
    """A topic told by the form of the text; callers with real topics pass their own column."""
    body = F.coalesce(text, F.lit(""))
    return (
        F.when(body.contains("License") | body.contains("Copyright"), "legal")
        .when(body.contains(" | "), "tabular")
        .when(body.contains("=") | body.contains("://") | body.contains("@"), "technical")
        .when(tokens < 100, "short").when(tokens >= 1000, "long").otherwise("article")
    )


def _targets(cells: DataFrame, dimension: str, given: dict[str, float] | None, temper: float) -> DataFrame:
    """Shares by value that sum to 1; only their sums, single numbers, pass the driver."""
    held = cells.groupBy(dimension).agg(F.sum("tokens").alias("t"))
    if given:
        known = F.element_at(F.create_map(*(F.lit(x) for pair in given.items() for x in pair)), F.col(dimension)).cast("double")
        share = F.coalesce(known, F.col("t") / F.lit(held.agg(F.sum("t")).first()[0] or 1))
    else:
        share = F.pow(F.col("t").cast("double"), F.lit(temper))
    shares = held.select(dimension, share.alias("share"))
    return shares.select(dimension, (F.col("share") / F.lit(shares.agg(F.sum("share")).first()[0] or 1.0)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """Cells (dimensions, tokens) with fitted `weight`s whose margins meet the targets.

    One number a sweep reaches the driver: the largest relative correction (`off`) that a margin needed.
    """
    fitted = cells.withColumn("weight", F.col("tokens").cast("double"))
    errors: list[float] = []
    while len(errors) < MAX_SWEEPS:
        fitted = fitted.withColumn("off", F.lit(0.0))
        for dimension, target in targets.items():
            held = fitted.groupBy(dimension).agg(F.sum("weight").alias("held"))
            factor = held.join(target, dimension).select(dimension, (F.col("target") / F.col("held")).alias("factor"))
            off = F.greatest("off", F.abs(F.col("factor") - 1)).alias("off")
            fitted = fitted.join(factor, dimension).select(*cells.columns, (F.col("weight") * F.col("factor")).alias("weight"), off)
            fitted = stored(fitted.coalesce(8), "raked")
        errors.append(fitted.agg(F.max("off")).first()[0] or 0.0)
        if errors[-1] <= TOLERANCE:
            return fitted.drop("off")
        if len(errors) >= max(sweeps, PATIENCE + 1) and errors[-1] > STALLED * errors[-1 - PATIENCE]:
            break
    warnings.warn(f"mixing targets are not met: sweep {len(errors)} still corrects a margin by {errors[-1]:.2g} of its target", RuntimeWarning, stacklevel=2)
    return fitted.drop("off")


def probabilities(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, sweeps: int = SWEEPS) -> DataFrame:
    """By cell of documents that have DIMENSIONS and tokens: the probability to keep a document."""
    cells = stored(docs.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    wanted = {d: stored(_targets(cells, d, (targets or {}).get(d), temper).coalesce(8), "mix-targets") for d in DIMENSIONS}
    ratio = rake(cells, wanted, sweeps).select(*DIMENSIONS, (F.col("weight") / F.col("tokens")).alias("ratio"))
    return ratio.select(*DIMENSIONS, (F.col("ratio") / F.lit(ratio.agg(F.max("ratio")).first()[0] or 1.0)).alias("probability"))


def mix(
    docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, topic: Column | None = None, temper: float = TEMPER,
    sweeps: int = SWEEPS, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """All documents with topic, tokens, probability and `kept`; keep those where `kept` to get the mix."""
    own = docs.drop(*ADDED)
    tokens = words(F.col(text))
    keyed = own.withColumn("tokens", tokens)
    keyed = keyed.withColumn("topic", F.coalesce(topic if topic is not None else form_topic(F.col(text), F.col("tokens")), F.lit("")))
    named = {f"_{d}": F.coalesce(F.col(d).cast("string"), F.lit("")) for d in DIMENSIONS}
    keyed = keyed.withColumns(named | {"_draw": content_bits(F.col(doc_id), F.col(text)) / F.lit(float(1 << BITS))})
    cells = keyed.select(*(F.col(f"_{d}").alias(d) for d in DIMENSIONS), "tokens")
    chance = probabilities(cells, targets, temper, sweeps).withColumnsRenamed({d: f"_{d}" for d in DIMENSIONS})
    joined = keyed.join(chance, [f"_{d}" for d in DIMENSIONS], "left")
    return joined.select(*own.columns, "topic", "tokens", "probability", (F.col("_draw") < F.col("probability")).alias("kept"))
