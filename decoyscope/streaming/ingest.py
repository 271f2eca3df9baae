"""Continuous ingest: sensor lines to the event table and the dead-letter table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from decoyscope.operators.ingest import REASONS, dead_letters, dedupe_events, normalize, valid_events
from decoyscope.sources.store import read_or_empty, stream_writer, write_batch

# One row per micro-batch; `repeated` are valid rows whose id came before in the same batch and day.
INGEST_METRICS = T.StructType([
    T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType()), T.StructField("observed_at", T.TimestampType()),
    *[T.StructField(name, T.LongType()) for name in ("lines", "valid", "rejected", "stored", "repeated")],
    T.StructField("reasons", T.MapType(T.StringType(), T.LongType())), T.StructField("event_date", T.DateType()),
])


def distinct_stream(events: DataFrame, within: str) -> DataFrame:
    """Drop re-delivered (day, id) pairs that come back within the given time of ingestion.

    The watermark runs on ingestion time, which only moves forward, so no late event is lost.
    """
    keyed = events.withColumns({"event_id": F.col("event.id"), "ingested": F.col("event.ingested")})
    return (
        keyed.withWatermark("ingested", within)
        .dropDuplicatesWithinWatermark(["event_date", "event_id"])
        .drop("event_id", "ingested")
    )


def ingest_stream(
    lines: DataFrame,
    events_path: str,
    letters_path: str,
    checkpoint: str,
    observer: str | None = None,
    available_now: bool = False,
    metrics_path: str | None = None,
) -> StreamingQuery:
    """Route every line to exactly one of two daily-partitioned tables.

    A batch is normalized once and written twice; both writes replace only this stream's own batch, so
    a batch that is replayed after a failure leaves no copies and any number of sensor inputs, each a
    stream of its own, can share the two tables. With `metrics_path`, what the two writes observed about their rows is
    written as a third table, one row per batch, before the batch counts as done: counting reads nothing again.
    """
    normalized = normalize(lines, observer=observer)

    def route(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        writer = stream_writer(batch)
        try:
            routed, kept = Observation(), Observation()
            write_batch(dead_letters(batch.observe(routed, *_routed())), letters_path, batch_id, writer)
            distinct = dedupe_events(valid_events(batch)).observe(kept, F.count(F.lit(1)).alias("stored"))
            write_batch(distinct, events_path, batch_id, writer)
            if metrics_path:
                _write_metrics(batch.sparkSession, {**routed.get, **kept.get}, metrics_path, batch_id, writer)
        finally:
            batch.unpersist()

    writer = normalized.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def _routed() -> list[Column]:
    """Counts of one batch's lines. They are taken in the write's last stage, where a repeated task counts once."""
    reason = F.col("reason")
    return [
        F.count(F.lit(1)).alias("lines"), F.count_if(reason.isNull()).alias("valid"), F.max("event.ingested").alias("observed_at"),
        *[F.count_if(reason == name).alias(f"reason:{name}") for name in REASONS],
    ]


def _write_metrics(spark: SparkSession, seen: dict[str, object], path: str, batch_id: int, writer: str) -> None:
    """One row; Spark logs the time of a batch, so a replay writes it to the same day. A batch without lines has no row."""
    if not seen.get("lines"):
        return
    lines, valid, stored = seen["lines"], seen["valid"], seen.get("stored", 0)
    reasons = {name: seen[f"reason:{name}"] for name in REASONS if seen[f"reason:{name}"]}
    row = (writer, batch_id, seen["observed_at"], lines, valid, lines - valid, stored, valid - stored, reasons)
    schema = T.StructType(INGEST_METRICS.fields[:-1])
    write_batch(spark.createDataFrame([row], schema).withColumn("event_date", F.to_date("observed_at")).coalesce(1), path, batch_id, writer)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """One row per stream and batch."""
    rows, rest = read_or_empty(spark, path, INGEST_METRICS), [name for name in INGEST_METRICS.fieldNames() if name not in ("stream", "batch")]
    return rows.groupBy("stream", "batch").agg(F.max_by(F.struct(*rest), "observed_at").alias("_row")).select("stream", "batch", "_row.*")


def metric_totals(metrics: DataFrame) -> DataFrame:
    """(stream, lines, valid, rejected, stored, repeated, batches, last_batch_at): how much every stream has read."""
    sums = [F.sum(name).alias(name) for name in ("lines", "valid", "rejected", "stored", "repeated")]
    return metrics.groupBy("stream").agg(*sums, F.count(F.lit(1)).alias("batches"), F.max("observed_at").alias("last_batch_at"))


def reason_totals(metrics: DataFrame) -> DataFrame:
    """(reason, count) of rejected lines, as `dead_letter_counts` counts them from the stored letters."""
    return metrics.select(F.explode("reasons").alias("reason", "count")).groupBy("reason").agg(F.sum("count").alias("count"))
