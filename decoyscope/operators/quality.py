"""Ingestion completeness and container resource summaries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decoyscope.functions.values import byte_quantity, parse_time, percent, safe_divide
from decoyscope.plans.skew import describe_values
from decoyscope.schemas import CONTAINER_STATS, RAW, RESOURCE_FIELDS


def sensor_ids(lines: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Each non-blank sensor line with its window status and, when it has one, its event id.

    Status is `filtered`, `unmappable` or `mappable`. With a window, a line without a usable time
    is unmappable; without one, time is not looked at.
    """
    broken = F.col("broken") | F.col("raw").isNull()
    parsed = F.struct(F.from_json("value", RAW).alias("raw"), F.try_parse_json("value").isNull().alias("broken"))
    occurred = parse_time(F.col("raw")["timestamp"])
    native = F.when(
        F.col("raw")["eventid"].isNotNull() & F.col("raw")["session"].isNotNull() & F.col("raw")["timestamp"].isNotNull(),
        F.concat_ws("-", F.col("raw")["eventid"], F.col("raw")["session"], F.col("raw")["timestamp"]),
    )
    identifier = F.coalesce(F.nullif(F.col("raw")["event_id"], F.lit("")), native)
    windowed = start is not None or end is not None
    outside = F.lit(False)
    if start is not None:
        outside = outside | (occurred < F.lit(start))
    if end is not None:
        outside = outside | (occurred > F.lit(end))
    status = F.when(broken, "unmappable")
    if windowed:
        status = status.when(occurred.isNull(), "unmappable").when(outside, "filtered")
    status = status.when(identifier.isNull(), "unmappable").otherwise("mappable")
    return (
        lines.where(F.col("value").rlike(r"\S"))
        .withColumn("_p", F.explode(F.array(parsed)))
        .select("_p.*")
        .select(status.alias("status"), F.when(status == "mappable", identifier).alias("event_id"))
    )


def stored_ids(events: DataFrame) -> DataFrame:
    return events.select(F.col("event.id").alias("event_id")).distinct()


def missing_ids(ids: DataFrame, events: DataFrame) -> DataFrame:
    """Mappable sensor ids that are not stored."""
    return _wanted(ids).join(stored_ids(events), "event_id", "left_anti")


def present_ids(ids: DataFrame, events: DataFrame) -> DataFrame:
    """Mappable sensor ids that are stored."""
    return _wanted(ids).join(stored_ids(events), "event_id", "left_semi")


def _wanted(ids: DataFrame) -> DataFrame:
    return ids.where("event_id IS NOT NULL").select("event_id").distinct()


def completeness(ids: DataFrame, events: DataFrame) -> DataFrame:
    """Window accounting and the stored share of the mappable ids, one row.

    Copies of an id collapse map-side to one row per (status, id) before the join.
    """
    counted = ids.groupBy("status", "event_id").agg(F.count("*").alias("_n"))
    marked = counted.join(stored_ids(events).withColumn("_stored", F.lit(True)), "event_id", "left")
    mappable = F.col("status") == "mappable"

    def lines(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("_n"))), F.lit(0)).cast("bigint")

    totals = marked.agg(
        lines(F.lit(True)).alias("sensor_events_total"),
        lines(F.col("status") != "filtered").alias("sensor_events_in_window"),
        lines(F.col("status") == "filtered").alias("filtered_out_events"),
        lines(F.col("status") == "unmappable").alias("unmappable_events"),
        F.count_if(mappable).alias("mappable_events"),
        F.count_if(mappable & F.col("_stored").isNotNull()).alias("matched_events"),
    )
    share = safe_divide(F.col("matched_events"), F.col("mappable_events")) * 100
    return totals.withColumn("completeness_percent", share)


def decode_container_stats(lines: DataFrame) -> DataFrame:
    """Container-stats JSON lines (value, host_label, timestamp) as numeric resource samples.

    Rows with a quantity, share or count that cannot be read are left out; see unreadable_container_stats.
    """
    return _container_stats(lines).where("readable").select(*RESOURCE_FIELDS)


def unreadable_container_stats(lines: DataFrame) -> DataFrame:
    """How many container-stats lines of each host could not be read."""
    return _container_stats(lines).where("NOT readable").groupBy("host_label").agg(F.count("*").alias("unreadable"))


def _container_stats(lines: DataFrame) -> DataFrame:
    item = F.from_json("value", CONTAINER_STATS)

    def side(name: str, index: int) -> Column:
        return byte_quantity(F.get(F.split(F.col("item")[name], "/", 2), F.lit(index)))

    stats = lines.withColumn("item", item).select(
        "timestamp",
        "host_label",
        F.coalesce(F.nullif(F.col("item.Name"), F.lit("")), F.col("item.Container")).alias("container_name"),
        percent(F.col("item.CPUPerc")).alias("cpu_percent"),
        side("MemUsage", 0).alias("memory_usage_bytes"),
        side("MemUsage", 1).alias("memory_limit_bytes"),
        percent(F.col("item.MemPerc")).alias("memory_percent"),
        side("NetIO", 0).alias("network_rx_bytes"),
        side("NetIO", 1).alias("network_tx_bytes"),
        side("BlockIO", 0).alias("block_read_bytes"),
        side("BlockIO", 1).alias("block_write_bytes"),
        F.col("item.PIDs").try_cast("bigint").alias("pids"),
    )
    readable = F.lit(True)
    for name in RESOURCE_FIELDS[3:]:
        readable = readable & F.col(name).isNotNull()
    return stats.withColumn("readable", readable)


RESOURCE_MEASURES = ("cpu_percent", "memory_usage_bytes", "memory_percent")


def _cells(samples: DataFrame) -> DataFrame:
    """Resource rows unpivoted to one (host, container, measure, number) per cell; bad cells are null."""
    pairs = [
        F.struct(F.lit(name).alias("measure"), F.trim(F.col(name).cast("string")).try_cast("double").alias("number"))
        for name in RESOURCE_MEASURES
    ]
    return samples.select("host_label", "container_name", F.inline(F.array(*pairs)))


def _labelled() -> Column:
    return (F.coalesce(F.col("host_label"), F.lit("")) != "") & (F.coalesce(F.col("container_name"), F.lit("")) != "")


def resource_summary(samples: DataFrame) -> DataFrame:
    """Count, mean, max and p95 of each measure per host and container, one row each."""
    keys = ["host_label", "container_name"]
    stats = describe_values(_cells(samples.where(_labelled())), [*keys, "measure"], "number")
    columns = []
    for name in RESOURCE_MEASURES:
        for stat in ("count", "mean", "max", "p95"):
            columns.append(F.max(F.when(F.col("measure") == name, F.col(stat))).alias(f"{name}_{stat}"))
    wide = stats.groupBy(*keys).agg(*columns)
    # Every readable cell is a sample, also one that is infinite or not a number and so in no mean.
    read = _cells(samples.where(_labelled())).groupBy(*keys, "measure").agg(F.count("number").alias("_read"))
    most = read.groupBy(*keys).agg(F.max("_read").alias("sample_count"))
    return wide.join(most, keys)


def invalid_samples(samples: DataFrame) -> DataFrame:
    """Rows without labels plus unreadable cells of labelled rows, one total."""
    unlabelled = samples.where(~_labelled()).agg(F.count("*").alias("_n"))
    bad_cells = _cells(samples.where(_labelled())).where("number IS NULL").agg(F.count("*").alias("_n"))
    return unlabelled.unionByName(bad_cells).agg(F.sum("_n").alias("invalid_samples"))
