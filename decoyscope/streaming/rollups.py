"""Stored panel rollups: minute counts and daily source sketches that batches add to and every window is summed from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from decoyscope.operators.sessions import is_internal
from decoyscope.plans.skew import latest_per_key
from decoyscope.plans.tables import Scratch
from decoyscope.sources.store import compact_days, read_or_empty, stream_writer, write_batch

SKETCH_BITS = 14  # 2**14 registers: a standard error of about 0.8 %

_DAY = T.StructField("event_date", T.DateType())
_BATCH = [T.StructField("writer", T.StringType()), T.StructField("batch_id", T.LongType())]
DELIVERIES = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("ingested", T.TimestampType()), T.StructField("ts", T.TimestampType()),
    T.StructField("external", T.BooleanType()), _DAY,
])
MINUTES = T.StructType([T.StructField("minute", T.TimestampType()), T.StructField("count", T.LongType()), _DAY])
SOURCES = T.StructType([T.StructField("sources", T.BinaryType()), _DAY])


@dataclass(frozen=True)
class Rollups:
    """Paths of the rollup tables; each batch adds one partition per day to each of them."""

    root: str

    @property
    def deliveries(self) -> str:
        """Id, times and visibility of every delivery that was counted."""
        return f"{self.root}/deliveries"

    @property
    def minutes(self) -> str:
        """Changes of the count of a minute."""
        return f"{self.root}/minutes"

    @property
    def sources(self) -> str:
        """Sketches of the distinct sources of a day."""
        return f"{self.root}/sources"


def roll_up_batch(batch: DataFrame, batch_id: int, rollups: Rollups) -> None:
    """Add one micro-batch of canonical events; late rows and re-deliveries correct the minutes they belong to.

    Of all deliveries of a (day, id) the last ingested counts, then the latest in time. A batch looks up earlier deliveries of
    its ids on its days in a narrow table of their own, and stores what it adds to and takes from each minute. All
    writes replace only this batch, and earlier deliveries are those of other batches, so a replay ends the same. A
    sketch does not forget: a source that a re-delivery takes away stays in its day.
    """
    spark, writer = batch.sparkSession, stream_writer(batch)
    keys, order = ["event_date", "id"], ["ingested", "ts", "external"]
    with Scratch(spark) as keep:
        delivered = batch.select(
            F.col("event.id").alias("id"), F.col("event.ingested").alias("ingested"), "ts", (~is_internal()).alias("external"),
            "event_date", F.col("source.ip").alias("source_ip"),
        )
        delivered = keep(delivered, "delivered")
        own = latest_per_key(delivered.drop("source_ip"), keys, order)
        days = [row.day for row in delivered.select(F.date_format("event_date", "yyyy-MM-dd").alias("day")).distinct().collect()]  # the days of one batch
        others = read_or_empty(spark, rollups.deliveries, T.StructType([*DELIVERIES.fields, *_BATCH])).where(
            F.col("event_date").isin([F.lit(day).cast("date") for day in days]) & ((F.col("writer") != writer) | (F.col("batch_id") != batch_id))
        )
        earlier = keep(latest_per_key(others.select(*DELIVERIES.fieldNames()).join(own.select(*keys), keys, "left_semi"), keys, order), "earlier")
        later = latest_per_key(earlier.unionByName(own), keys, order)
        changes = later.withColumn("_sign", F.lit(1)).unionByName(earlier.withColumn("_sign", F.lit(-1))).where("external")
        minutes = changes.groupBy("event_date", F.date_trunc("minute", "ts").alias("minute")).agg(F.sum("_sign").alias("count")).where("count <> 0")
        sketches = delivered.where("external").groupBy("event_date").agg(F.hll_sketch_agg("source_ip", SKETCH_BITS).alias("sources"))
        write_batch(minutes.coalesce(1), rollups.minutes, batch_id, writer)  # a row per minute of the batch
        write_batch(sketches.coalesce(1), rollups.sources, batch_id, writer)  # a row per day of the batch
        write_batch(own, rollups.deliveries, batch_id, writer)


def rollup_stream(events: DataFrame, rollups: Rollups, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    def store(batch: DataFrame, batch_id: int) -> None:
        roll_up_batch(batch, batch_id, rollups)

    running = events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    running = running.trigger(availableNow=True) if available_now else running.trigger(processingTime="10 seconds")
    return running.start()


def minute_counts(spark: SparkSession, rollups: Rollups) -> DataFrame:
    """(event_date, minute, count) of external traffic, without empty minutes."""
    return _sum_minutes(read_or_empty(spark, rollups.minutes, MINUTES)).where("count > 0")


def rolled_histogram(minutes: DataFrame, interval: str) -> DataFrame:
    """Epoch-aligned buckets of whole minutes, summed from minute counts; no event is read."""
    return minutes.groupBy(F.window("minute", interval).alias("_w")).agg(F.sum("count").alias("count")).select(
        F.col("_w.start").alias("bucket"), "count"
    )


def source_windows(spark: SparkSession, rollups: Rollups, days: int) -> DataFrame:
    """(last_day, unique_sources): estimated distinct sources of every window of `days` days that has events."""
    daily = _merge_sources(read_or_empty(spark, rollups.sources, SOURCES))
    ends = daily.select("sources", F.explode(F.sequence("event_date", F.date_add("event_date", days - 1))).alias("last_day"))
    return ends.groupBy("last_day").agg(F.hll_sketch_estimate(F.hll_union_agg("sources")).alias("unique_sources"))


def compact_rollups(spark: SparkSession, rollups: Rollups, before: Column) -> None:
    """One partition a day, one row a minute, one sketch a day, one delivery an id, for days before the given date."""

    def last(rows: DataFrame) -> DataFrame:
        return latest_per_key(rows, ["event_date", "id"], ["ingested", "ts", "external"])

    compact_days(spark, rollups.deliveries, DELIVERIES, before, ("id",), last, "id")
    compact_days(spark, rollups.minutes, MINUTES, before, ("minute",), _sum_minutes)
    compact_days(spark, rollups.sources, SOURCES, before, (), _merge_sources)


def _sum_minutes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("event_date", "minute").agg(F.sum("count").alias("count"))


def _merge_sources(rows: DataFrame) -> DataFrame:
    return rows.groupBy("event_date").agg(F.hll_union_agg("sources").alias("sources"))
