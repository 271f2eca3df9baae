"""Dashboard panels, event search, saved views and housekeeping counts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decoyscope.functions.ip import is_loopback
from decoyscope.operators.sessions import is_internal
from decoyscope.schemas import ALLOWED_MINUTES, FLEET

# Display names of the fleet.
FLEET_NAMES = {
    "cowrie": "Cowrie SSH/Telnet",
    "camera": "IP Camera",
    "iot-service": "IoT TCP Device",
    "mqtt": "MQTT Broker",
    "router": "Router Admin",
}


def recent_window(df: DataFrame, ts: str, as_of: datetime | Column, minutes: int) -> DataFrame:
    """Rows from the last `minutes`, without an upper bound; prunes daily partitions where there are any."""
    if minutes not in ALLOWED_MINUTES:
        raise ValueError(f"minutes must be one of {', '.join(map(str, ALLOWED_MINUTES))}")
    return since(df, ts, as_of, minutes)


def since(df: DataFrame, ts: str, as_of: datetime | Column, minutes: int) -> DataFrame:
    limit = (as_of if isinstance(as_of, Column) else F.lit(as_of)) - F.make_interval(mins=F.lit(minutes))
    rows = df.where(F.col(ts) >= limit)
    return rows.where(F.col("event_date") >= F.to_date(limit)) if "event_date" in df.columns else rows


def analytics_events(events: DataFrame, as_of: datetime | Column, minutes: int) -> DataFrame:
    """Window plus internal exclusion; rows without an address or flag are kept."""
    return recent_window(events, "ts", as_of, minutes).where(~is_internal())


def histogram_interval(minutes: int) -> str:
    if minutes <= 60:
        return "1 minute"
    if minutes <= 360:
        return "10 minutes"
    if minutes <= 1440:
        return "1 hour"
    if minutes <= 10080:
        return "12 hours"
    return "1 day" if minutes <= 43200 else "7 days"


def time_histogram(events: DataFrame, interval: str, ts: str = "ts") -> DataFrame:
    """Epoch-aligned fixed buckets; empty buckets are absent."""
    return events.groupBy(F.window(ts, interval).alias("_w")).agg(F.count("*").alias("count")).select(
        F.col("_w.start").alias("bucket"), "count"
    )


def peak_bucket(histogram: DataFrame) -> DataFrame:
    return histogram.agg(F.max("count").alias("peak"))


def top_terms(df: DataFrame, field: str, size: int) -> DataFrame:
    """Most frequent values of a field: count descending, then name."""
    return (
        df.where(F.col(field).isNotNull())
        .groupBy(F.col(field).alias("name"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), F.asc("name"))
        .limit(size)
    )


def auth_outcomes(events: DataFrame) -> DataFrame:
    return top_terms(events.where(F.col("event.category") == "authentication"), "event.outcome", 5)


def distinct_sources(events: DataFrame, exact: bool = False) -> DataFrame:
    counted = F.count_distinct("source.ip") if exact else F.approx_count_distinct("source.ip")
    return events.agg(counted.alias("unique_sources"))


def source_honeypot_matrix(events: DataFrame, sources: int = 8, honeypots: int = 10) -> DataFrame:
    """Counts per (source, honeypot) for the most active sources, largest honeypots first."""
    cells = events.where(F.col("source.ip").isNotNull()).groupBy(
        F.col("source.ip").alias("source"), F.col("honeypot.id").alias("honeypot")
    ).agg(F.count("*").alias("count"))
    leaders = (
        cells.groupBy("source").agg(F.sum("count").alias("total"))
        .orderBy(F.desc("total"), F.asc("source")).limit(sources).select("source")
    )
    order = Window.partitionBy("source").orderBy(F.desc("count"), F.asc("honeypot"))
    return (
        cells.where(F.col("honeypot").isNotNull())
        .join(leaders, "source", "left_semi")
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= honeypots)
        .select("source", "honeypot", "count")
    )


def dense_matrix(events: DataFrame) -> DataFrame:
    """The matrix with a zero for every missing cell and each cell's share of the maximum.

    Both axes are top-k lists of at most 8 and 10 names, so they travel as one short row.
    """
    cells = source_honeypot_matrix(events)
    axes = (
        cells.select("source").distinct().select("source", F.lit(None).cast("string").alias("honeypot"))
        .unionByName(top_terms(events, "honeypot.id", 10).select(F.lit(None).cast("string").alias("source"), F.col("name").alias("honeypot")))
        .agg(F.collect_set("source").alias("sources"), F.collect_set("honeypot").alias("honeypots"))
    )
    grid = axes.select(F.explode("sources").alias("source"), "honeypots").select("source", F.explode("honeypots").alias("honeypot"))
    filled = grid.join(cells, ["source", "honeypot"], "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("bigint"))
    grid_wide = Window.partitionBy(F.lit(1))  # at most 80 cells
    return filled.withColumn("intensity", F.col("count") / F.greatest(F.max("count").over(grid_wide), F.lit(1)))


def bar_shares(terms: DataFrame) -> DataFrame:
    """Bar widths of a top-k list: count over the largest count."""
    everything = Window.partitionBy(F.lit(1))
    return terms.withColumn("share", F.col("count") / F.greatest(F.max("count").over(everything), F.lit(1)))


def totals(events: DataFrame, sessions: DataFrame, detections: DataFrame) -> DataFrame:
    """The headline numbers in long form: name, total."""
    def named(df: DataFrame, **columns: Column) -> DataFrame:
        pairs = [F.struct(F.lit(name).alias("name"), F.coalesce(c, F.lit(0)).cast("bigint").alias("total")) for name, c in columns.items()]
        return df.agg(F.array(*pairs).alias("_t")).select(F.inline("_t"))

    return (
        named(events, events=F.count("*"), unique_sources=F.count_distinct("source.ip"))
        .unionByName(
            named(
                sessions,
                sessions=F.count("*"),
                failed_auth_attempts=F.sum("failed_authentication_attempts"),
                multi_honeypot_sessions=F.count_if(F.size("honeypots_touched") > 1),
            )
        )
        .unionByName(named(detections, detections=F.count("*")))
    )


def table_counts(**tables: DataFrame) -> DataFrame:
    """Row count per named table; pass empty frames for absent tables."""
    frames = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in tables.items()]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def fleet_counts(events: DataFrame) -> DataFrame:
    """Events per member of the fixed fleet (zero included) and its share of the busiest."""
    members = events.sparkSession.createDataFrame([(m, FLEET_NAMES[m]) for m in FLEET], "honeypot string, display_name string")
    counts = events.groupBy(F.col("honeypot.id").alias("_id")).agg(F.count("*").alias("_n"))
    joined = counts.join(members, F.concat("honeypot", F.lit("-01")) == F.col("_id"), "right").select(
        "honeypot", "display_name", F.coalesce("_n", F.lit(0)).alias("event_count")
    )
    everything = Window.partitionBy(F.lit(1))
    return joined.withColumn(
        "share", F.col("event_count") / F.greatest(F.max("event_count").over(everything), F.lit(1))
    )


_SEARCH_FIELDS = {
    "honeypot": "honeypot.id",
    "source_ip": "source.ip",
    "protocol": "network.protocol",
    "category": "event.category",
    "action": "event.action",
    "outcome": "event.outcome",
}


def search_events(
    events: DataFrame, size: int = 100, minutes: int | None = None, as_of: datetime | Column | None = None, **equals: str | None
) -> DataFrame:
    """Newest events that match every given filter."""
    if not 1 <= size <= 500:
        raise ValueError("size must be between 1 and 500")
    rows = events
    for name, value in equals.items():
        if value:
            rows = rows.where(F.col(_SEARCH_FIELDS[name]) == value)
    if minutes is not None:
        if not 1 <= minutes <= 525600:
            raise ValueError("minutes must be between 1 and 525600")
        rows = since(rows, "ts", F.current_timestamp() if as_of is None else as_of, minutes)
    return newest(rows, "ts", size, "event.id")


def newest(df: DataFrame, order: str, size: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(order), F.asc(tie)).limit(size)


def recent_sessions(sessions: DataFrame, size: int = 200) -> DataFrame:
    return newest(sessions, "start_time", size, "session_id")


def recent_detections(detections: DataFrame, size: int = 200) -> DataFrame:
    return newest(detections, "timestamp", size, "detection_id")


def recent_experiments(experiments: DataFrame, size: int = 200) -> DataFrame:
    return newest(experiments, "created_at", size, "experiment_id")


def recent_detections_with_source(
    detections: DataFrame, sessions: DataFrame, size: int = 8, shown_sessions: int | None = None
) -> DataFrame:
    """Newest detections with their session's source.

    With `shown_sessions`, only that many newest sessions are looked up and other sources go blank,
    as on the overview page; by default every session is.
    """
    looked_up = sessions if shown_sessions is None else recent_sessions(sessions, shown_sessions)
    shown = recent_detections(detections, size).drop("source_ip")
    return shown.join(looked_up.select("session_id", "source_ip"), "session_id", "left")


def by_id(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.where(F.col(key) == value).limit(1)


def by_ids(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Events whose id is in `ids.event_id`."""
    return events.join(ids.select(F.col("event_id").alias("_wanted")).distinct(), F.col("event.id") == F.col("_wanted"), "left_semi")


# Column lists of the saved views.
VIEW_COLUMNS = ("ts", "source.ip", "honeypot.id", "network.protocol", "event.action", "event.outcome", "message")
EXPERIMENT_VIEW_COLUMNS = ("experiment_id", "name", "scenario_id", "status", "result")


def _flat_names(columns: Sequence[str]) -> list[Column]:
    return [F.col(name).alias(name.replace(".", "_")) for name in columns]


def saved_view(name: str, events: DataFrame) -> DataFrame:
    """One of the six event views, newest first."""
    conditions = {
        "event_overview": F.lit(True),
        "honeypot_activity": F.col("honeypot.id").isNotNull(),
        "source_ip_analysis": F.col("source.ip").isNotNull(),
        "protocol_distribution": F.col("network.protocol").isNotNull(),
        "authentication_attempts": F.col("event.category") == "authentication",
        "attack_timeline": F.col("event.action").isNotNull(),
    }
    return events.where(conditions[name]).orderBy(F.desc("ts")).select(*_flat_names(VIEW_COLUMNS))


def experiment_view(experiments: DataFrame) -> DataFrame:
    return experiments.where("status IS NOT NULL").orderBy(F.desc("start_time")).select(*EXPERIMENT_VIEW_COLUMNS)


def internal_derived_counts(**tables: DataFrame) -> DataFrame:
    """Dry run of the cleanup: derived rows with a loopback source, per table."""
    return table_counts(**{name: df.where(is_loopback(F.col("source_ip"))) for name, df in tables.items()})


def without_internal(derived: DataFrame) -> DataFrame:
    """The cleanup itself: derived rows that stay."""
    return derived.where(~is_loopback(F.col("source_ip")))
