"""Running top lists: batches store their frequent names with an error bound, a read counts exactly only names that can be in the list."""

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

TRACKED = 1024  # frequent names of a batch and day, at most; what a name can have unseen is a share of 1 in this many rows

_DAY = T.StructField("event_date", T.DateType())
_NAME, _COUNT = T.StructField("name", T.StringType()), T.StructField("count", T.LongType())
_BATCH = [T.StructField("writer", T.StringType()), T.StructField("batch_id", T.LongType())]
DELIVERIES = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("ingested", T.TimestampType()), T.StructField("ts", T.TimestampType()), _NAME, _DAY,
])
CHANGES = T.StructType([_NAME, _COUNT, _DAY])
FREQUENT = T.StructType([_NAME, _COUNT, T.StructField("covered", T.LongType()), _DAY])
BOUNDS = T.StructType([T.StructField("bound", T.LongType()), _DAY])


@dataclass(frozen=True)
class TopLists:
    """Paths of the tables of one field of external events; each batch adds one partition per day to each of them."""

    root: str
    field: str = "source.ip"
    tracked: int = TRACKED

    @property
    def deliveries(self) -> str:
        """Id, times and name of every delivery that was counted."""
        return f"{self.root}/deliveries"

    @property
    def changes(self) -> str:
        """What a batch changes in the count of every name of a day, by name."""
        return f"{self.root}/changes"

    @property
    def frequent(self) -> str:
        """The changes of frequent names, and the bounds of the batches in which a name was one."""
        return f"{self.root}/frequent"

    @property
    def bounds(self) -> str:
        """The most that a batch adds to a name that is not among its frequent ones."""
        return f"{self.root}/bounds"


def count_batch(batch: DataFrame, batch_id: int, lists: TopLists) -> None:
    """Add one micro-batch of canonical events; of all deliveries of a (day, id) the last ingested counts, then the latest in time.

    A name is frequent in a batch and day if it gains more than the day's total gain / `tracked`, so there are less than `tracked`
    and a limit of any name left out is known without ranking. A name that loses rows to re-deliveries is kept as well:
    what is left out is never negative. Rows without a name are not counted. All writes replace only this batch and
    earlier deliveries are those of other batches, so a replay ends the same.
    """
    spark, writer = batch.sparkSession, stream_writer(batch)
    keys, order = ["event_date", "id"], ["ingested", "ts"]
    with Scratch(spark) as keep:
        name = F.when(~is_internal(), F.col(lists.field).cast("string")).alias("name")
        delivered = batch.select(F.col("event.id").alias("id"), F.col("event.ingested").alias("ingested"), "ts", name, "event_date")
        own = keep(latest_per_key(delivered, keys, order), "own")
        days = [row.day for row in own.select(F.date_format("event_date", "yyyy-MM-dd").alias("day")).distinct().collect()]  # the days of one batch
        others = read_or_empty(spark, lists.deliveries, T.StructType([*DELIVERIES.fields, *_BATCH])).where(
            F.col("event_date").isin([F.lit(day).cast("date") for day in days]) & ((F.col("writer") != writer) | (F.col("batch_id") != batch_id))
        )
        earlier = keep(latest_per_key(others.select(*DELIVERIES.fieldNames()).join(own.select(*keys), keys, "left_semi"), keys, order), "earlier")
        later = latest_per_key(earlier.unionByName(own), keys, order)
        signed = later.withColumn("_sign", F.lit(1)).unionByName(earlier.withColumn("_sign", F.lit(-1))).where("name IS NOT NULL")
        changes = keep(signed.groupBy("event_date", "name").agg(F.sum("_sign").alias("count")).where("count <> 0"), "changes")
        gained = F.sum(F.greatest("count", F.lit(0)))
        bounds = changes.groupBy("event_date").agg(F.floor(gained / lists.tracked).cast("bigint").alias("bound"))
        frequent = changes.join(bounds, "event_date").where((F.col("count") > F.col("bound")) | (F.col("count") < 0)).withColumnRenamed("bound", "covered")
        write_batch(frequent.coalesce(1), lists.frequent, batch_id, writer)  # `tracked` names a day, and those that re-deliveries take rows from
        write_batch(bounds.coalesce(1), lists.bounds, batch_id, writer)  # a row per day of the batch
        write_batch(changes, lists.changes, batch_id, writer, ("name",), {"parquet.bloom.filter.enabled#name": "true"})
        write_batch(own, lists.deliveries, batch_id, writer)


def top_stream(events: DataFrame, lists: TopLists, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    def count(batch: DataFrame, batch_id: int) -> None:
        count_batch(batch, batch_id, lists)

    running = events.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint)
    running = running.trigger(availableNow=True) if available_now else running.trigger(processingTime="10 seconds")
    return running.start()


def _within(rows: DataFrame, first: Column | None, last: Column | None) -> DataFrame:
    day = F.col("event_date")
    rows = rows if first is None else rows.where(day >= first)
    return rows if last is None else rows.where(day <= last)


def name_limits(spark: SparkSession, lists: TopLists, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """(name, least, most): limits of the count of every name that was frequent in some batch of the days.

    What a name gained unseen is at most the bounds of the batches in which it was not frequent.
    """
    seen = _sum_frequent(_within(read_or_empty(spark, lists.frequent, FREQUENT), first, last), "name")
    unseen = F.lit(_total_bound(spark, lists, first, last)) - F.col("covered")
    return seen.select("name", F.greatest("count", F.lit(0)).alias("least"), (F.col("count") + unseen).alias("most"))


def _total_bound(spark: SparkSession, lists: TopLists, first: Column | None, last: Column | None) -> int:
    """The most that a name gained in batches without ever being frequent."""
    return _within(read_or_empty(spark, lists.bounds, BOUNDS), first, last).agg(F.sum("bound").alias("bound")).first().bound or 0


def top_names(spark: SparkSession, lists: TopLists, size: int, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """(name, count): the most frequent names of the days, count descending, then name; exact.

    The `size`-th greatest lower limit decides which names can be in the list. Where a name that was never frequent could
    be one as well, all names are counted; either way from changes, not from events.
    """
    limits = name_limits(spark, lists, first, last)
    leaders = limits.orderBy(F.desc("least")).limit(size).agg(F.count("*").alias("n"), F.min("least").alias("least")).first()
    least = leaders.least if leaders.n == size else 0
    changes = _within(read_or_empty(spark, lists.changes, CHANGES), first, last)
    if _total_bound(spark, lists, first, last) < max(least, 1):
        changes = changes.join(limits.where(F.col("most") >= max(least, 1)).select("name"), "name", "left_semi")
    counted = changes.groupBy("name").agg(F.sum("count").alias("count")).where("count > 0")
    return counted.orderBy(F.desc("count"), F.asc("name")).limit(size)


def compact_top_lists(spark: SparkSession, lists: TopLists, before: Column) -> None:
    """One partition a day and one row a name or id for days before the given date; limits stay what they were."""

    def last(rows: DataFrame) -> DataFrame:
        return latest_per_key(rows, ["event_date", "id"], ["ingested", "ts"])

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("event_date", "name").agg(F.sum("count").alias("count")).where("count <> 0")

    compact_days(spark, lists.deliveries, DELIVERIES, before, ("id",), last, "id")
    compact_days(spark, lists.changes, CHANGES, before, ("name",), summed, "name")
    compact_days(spark, lists.frequent, FREQUENT, before, ("name",), lambda rows: _sum_frequent(rows, "event_date", "name"))
    compact_days(spark, lists.bounds, BOUNDS, before, (), lambda rows: rows.groupBy("event_date").agg(F.sum("bound").alias("bound")))


def _sum_frequent(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("count").alias("count"), F.sum("covered").alias("covered"))
