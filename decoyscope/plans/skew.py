"""Building blocks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decoyscope.functions.values import is_finite, micros


def spread_column(on: Sequence[str], spread: int) -> Column:
    """Deterministic salt in [0, spread), stable across task retries."""
    return F.pmod(F.xxhash64(*[F.col(name) for name in on]), F.lit(spread)).cast("int")


def spread_lookup(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread_on: Sequence[str],
    spread: int,
    how: str = "inner",
) -> DataFrame:
    """Join `left` to a `right` that is unique per `keys`, with hot keys cut into `spread` parts.

    Only the (key, salt) combinations that `left` really holds are replicated, so a key with
    one row costs one row and a hot key costs at most `spread`.
    """
    salted = left.withColumn("_spread", spread_column(spread_on, spread))
    cells = salted.select(*keys, "_spread").distinct().join(right, list(keys), how)
    return salted.join(cells, [*keys, "_spread"], how).drop("_spread")


def not_broadcast(exploded: DataFrame) -> DataFrame:
    """Join `exploded` by a shuffle: Spark's size estimate leaves out what explode repeats, so it would pass for small."""
    return exploded.hint("merge")


def repeated_lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], spread_on: Sequence[str], spread: int, how: str = "inner") -> DataFrame:
    """`spread_lookup` for a small `right`: every row of it is repeated per salt, and `left` is evaluated once."""
    salted = left.withColumn("_spread", spread_column(spread_on, spread))
    copies = not_broadcast(right.withColumn("_spread", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))))
    return salted.join(copies, [*keys, "_spread"], how).drop("_spread")


def slot(ts: Column, width_us: int) -> Column:
    return F.floor(micros(ts) / F.lit(width_us)).cast("bigint")


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    ts: str,
    start: str,
    end: str,
    slot_seconds: int,
    spread: int,
    spread_on: Sequence[str],
    few_intervals: bool = False,
) -> DataFrame:
    """Inner join on `keys` and `start <= ts <= end`, both inclusive.

    Time slots join as one more equality, so the join never scans all intervals of a key, and
    a salt cuts a hot (key, slot). An interval is repeated only for the (slot, salt) combinations that
    the points really hold, and repeated rows are never broadcast. Where the intervals are the few,
    points outside all their slots are left out first.
    """
    width = slot_seconds * 1_000_000
    salted = points.withColumn("_slot", slot(F.col(ts), width)).withColumn("_spread", spread_column(spread_on, spread))
    slotted = intervals.where(F.col(start) <= F.col(end)).withColumn(
        "_slot", F.explode(F.sequence(slot(F.col(start), width), slot(F.col(end), width)))
    )
    cells = salted.select(*keys, "_slot", "_spread").distinct()
    pieces = not_broadcast(not_broadcast(slotted).join(cells, [*keys, "_slot"]))
    if few_intervals:
        salted = salted.join(not_broadcast(slotted.select(*keys, "_slot").distinct()), [*keys, "_slot"], "left_semi")
    return (
        salted.join(pieces, [*keys, "_slot", "_spread"])
        .where(F.col(ts).between(F.col(start), F.col(end)))
        .drop("_slot", "_spread")
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by `order`, remaining columns break ties.

    An aggregate, not a window: copies collapse map-side, so a key with very many copies never
    meets in one task.
    """
    rest = [name for name in df.columns if name not in keys and name not in order]
    packed = F.max(F.struct(*order, *rest)).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, "_row.*").select(*df.columns)


def running_counts(df: DataFrame, keys: Sequence[str], ts: str, counts: Sequence[str], slot_seconds: int) -> DataFrame:
    """Per distinct (key, ts): totals of `counts` over all rows of the key up to and including ts.

    Prefix sums in two levels (slots, then instants within a slot) after map-side counting, so a
    window task holds one slot of one key instead of the whole key.
    """
    instants = (
        df.groupBy(*keys, ts)
        .agg(*[F.sum(name).alias(name) for name in counts])
        .withColumn("_slot", slot(F.col(ts), slot_seconds * 1_000_000))
    )
    by_slot = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = instants.groupBy(*keys, "_slot").agg(*[F.sum(name).alias(f"_s_{name}") for name in counts])
    for name in counts:
        slots = slots.withColumn(f"_before_{name}", F.coalesce(F.sum(f"_s_{name}").over(by_slot), F.lit(0)))
    slots = slots.drop(*[f"_s_{name}" for name in counts])
    inside = Window.partitionBy(*keys, "_slot").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    joined = instants.join(slots, [*keys, "_slot"])
    return joined.select(
        *keys,
        ts,
        *[(F.sum(name).over(inside) + F.col(f"_before_{name}")).alias(f"{name}_to_date") for name in counts],
    )


def _magnitude_bin(value: Column) -> Column:
    """Order-preserving BIGINT bin of about 0.07 % relative width (1024 per power of two)."""
    log = F.floor(F.log2(F.abs(value)) * 1024).cast("bigint") + F.lit(1100 * 1024)
    return F.when(value > 0, log).when(value < 0, -log).otherwise(F.lit(0).cast("bigint"))


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, percents: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation percentiles per key, one column per entry of `percents`.

    The built-in exact percentile gathers all distinct values of a group in one buffer. Here
    (value, count) pairs are counted map-side, binned by magnitude, and only the few bins that
    hold a wanted rank are ordered, so the largest group is spread over many tasks.
    Null and non-finite values are ignored; a key without values has no row.
    """
    keys = list(keys)
    values = (
        df.where(is_finite(F.col(value)))
        .select(*keys, (F.col(value).cast("double") + F.lit(0.0)).alias("_v"))
        .groupBy(*keys, _magnitude_bin(F.col("_v")).alias("_bin"), "_v")
        .agg(F.count("*").alias("_n"))
    )
    per_key = Window.partitionBy(*keys)
    earlier_bins = per_key.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        values.groupBy(*keys, "_bin")
        .agg(F.sum("_n").alias("_in_bin"))
        .withColumn("_before", F.coalesce(F.sum("_in_bin").over(earlier_bins), F.lit(0)))
        .withColumn("_total", F.sum("_in_bin").over(per_key))
    )

    def position(p: float) -> Column:
        return (F.col("_total") - 1) * F.lit(p)

    wanted = F.array_distinct(
        F.array(*[edge(position(p)).cast("bigint") for p in percents.values() for edge in (F.floor, F.ceil)])
    )
    hits = (
        bins.withColumn("_ranks", F.filter(wanted, lambda r: r.between(F.col("_before"), F.col("_before") + F.col("_in_bin") - 1)))
        .where(F.size("_ranks") > 0)
        .drop("_in_bin")
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    picked = (
        values.join(hits, [*keys, "_bin"])
        .withColumn("_from", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .withColumn("_rank", F.explode(F.filter("_ranks", lambda r: r.between(F.col("_from"), F.col("_from") + F.col("_n") - 1))))
    )

    def pick(rank: Column) -> Column:
        return F.max(F.when(F.col("_rank") == rank.cast("bigint"), F.col("_v")))

    edges = picked.groupBy(*keys, "_total").agg(
        *[pick(F.floor(position(p))).alias(f"_lo_{name}") for name, p in percents.items()],
        *[pick(F.ceil(position(p))).alias(f"_hi_{name}") for name, p in percents.items()],
    )
    out = []
    for name, p in percents.items():
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * (position(p) - F.floor(position(p)))).alias(name))
    return edges.select(*keys, *out)


def describe_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, min, mean, p50, median, p95, max and sample deviation per key; null rows keep their key."""
    keys = list(keys)
    number = F.when(is_finite(F.col(value)), F.col(value).cast("double"))
    base = df.groupBy(*keys).agg(
        F.count(number).alias("count"),
        F.min(number).alias("min"),
        F.avg(number).alias("mean"),
        F.max(number).alias("max"),
        F.stddev_samp(number).alias("standard_deviation"),
        F.count_if(F.col(value).isNull()).alias("missing_or_invalid_count"),
    )
    ranks = exact_percentiles(df, keys, value, {"p50": 0.5, "p95": 0.95})
    return base.join(ranks, keys, "left").select(
        *keys, "count", "min", "mean", "p50", F.col("p50").alias("median"), "p95", "max",
        "standard_deviation", "missing_or_invalid_count",
    )
