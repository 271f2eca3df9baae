"""Incremental sessions and detections: each batch sums up the slots it touches and merges them with stored cells."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from decoyscope.operators.detections import detect, keep_first_seen
from decoyscope.operators.ingest import dedupe_events
from decoyscope.operators.sessions import (
    CELL_KEYS, chain_cells, event_slot, external_events, flat_events, merge_cells, session_cells, session_paths, slot_start,
)
from decoyscope.plans.tables import delete_path
from decoyscope.schemas import DEAD_LETTER, DETECTION, EVENT, SESSION, SESSION_CELL, SESSION_PATH
from decoyscope.settings import DEFAULTS, Settings
from decoyscope.sources.store import COMPACTED, compact_days, read_days, read_or_empty, stream_writer, upsert, write_batch


@dataclass(frozen=True)
class Store:
    """Paths of the tables of one deployment.

    Ingest streams write `raw_events`, which the processor only reads; `events` is the processor's own.
    """

    root: str

    @property
    def raw_events(self) -> str:
        return f"{self.root}/raw_events"

    @property
    def events(self) -> str:
        return f"{self.root}/events"

    @property
    def cells(self) -> str:
        """Mergeable state of sessions, per source and slot."""
        return f"{self.root}/session_cells"

    @property
    def paths(self) -> str:
        """Distinct web paths per source and slot."""
        return f"{self.root}/session_paths"

    @property
    def dead_letters(self) -> str:
        return f"{self.root}/dead_letters"

    @property
    def sessions(self) -> str:
        return f"{self.root}/sessions"

    @property
    def detections(self) -> str:
        return f"{self.root}/detections"


def read_events(spark: SparkSession, store: Store) -> DataFrame:
    """All stored events, one row per (day, id)."""
    return dedupe_events(read_or_empty(spark, store.events, EVENT))


EVENT_CLUSTER = ("source.ip", "ts")
LETTER_CLUSTER = ("reason", "seen_at")


def compact_events(spark: SparkSession, store: Store, before: Column, path: str | None = None) -> None:
    """One partition and one row per (day, id) for every stored day before the given date, by source and time.

    For the processor's events, or for another event table of the store such as `raw_events`.
    """
    compact_days(spark, path or store.events, EVENT, before, EVENT_CLUSTER, dedupe_events, "event.id")


def compact_letters(spark: SparkSession, store: Store, before: Column) -> None:
    """One partition for every day of dead letters before the given date, by reason and time; no letter is dropped."""
    compact_days(spark, store.dead_letters, DEAD_LETTER, before, LETTER_CLUSTER)


def stream_raw_events(spark: SparkSession, store: Store) -> DataFrame:
    """`raw_events` as a stream for the processor, without what compaction wrote again.

    Compact only days whose rows every reading stream has read, for their first files go.
    """
    writer = StructType([*EVENT.fields, StructField("writer", StringType())])
    return spark.readStream.schema(writer).parquet(store.raw_events).where(F.col("writer") != COMPACTED).drop("writer")


def _literal_days(frame: DataFrame, day: Column) -> Column:
    """Partition filter of the days that a small frame names: literals, so only their folders are listed and read.

    Days are formatted and parsed by Spark, so the driver's time zone does not matter.
    """
    rows = frame.select(F.date_format(day, "yyyy-MM-dd").alias("d")).where("d IS NOT NULL").distinct().collect()
    return _in_days([row.d for row in rows])


def _in_days(days: list[str]) -> Column:
    column = F.col("day")
    return column.isin([F.lit(day).cast("date") for day in days]) if days else F.lit(False)


def _days_between(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.to_date(start), F.to_date(end)))


def _stored_events(spark: SparkSession, store: Store, wanted: Column) -> DataFrame:
    return read_or_empty(spark, store.events, EVENT).withColumn("day", F.col("event_date")).where(wanted)


def _slots_of(events: DataFrame, settings: Settings) -> DataFrame:
    return external_events(events).select(F.col("source.ip").alias("source_ip"), event_slot(F.col("ts"), settings).alias("slot"))


def _plan_changes(spark: SparkSession, batch: DataFrame, store: Store, keep: Redo, settings: Settings) -> dict[str, int]:
    """Work out, and write under `keep`, what a stored batch changes in the cells, paths, sessions and detections.

    1. A batch touches the slots of its rows, and those where earlier deliveries of the same ids lay.
    2. Events are read in touched slots only (with all deliveries of their ids) and summed up to new cells.
    3. Sessions that a touched slot can change are those of the stored cells in it and in the slots beside it, for a gap
       that keeps a session together reaches no further. Their other cells are read as they are stored, on the
       days these sessions cover.
    4. Cells are chained and merged to sessions; sessions, cells and paths that are no more are listed as stale.
    """
    own = _slots_of(batch, settings)
    held = _stored_events(spark, store, _literal_days(batch, F.col("event_date")))
    ids = batch.select(F.col("event_date").alias("day"), F.col("event.id").alias("_id")).distinct()
    earlier = held.withColumn("_id", F.col("event.id")).join(ids, ["day", "_id"], "left_semi")
    touched = keep(own.unionByName(_slots_of(earlier, settings)).distinct(), "touched")

    near_slots = touched.select("source_ip", F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)).alias("slot")).distinct()
    slot_days = touched.select(_days_between(slot_start(F.col("slot"), settings), slot_start(F.col("slot") + 1, settings)).alias("day"))
    candidates = _stored_events(spark, store, _literal_days(slot_days, F.col("day")))
    placed = candidates.withColumns({"_id": F.col("event.id"), "source_ip": F.col("source.ip"), "slot": event_slot(F.col("ts"), settings)})
    members = placed.join(touched, ["source_ip", "slot"], "left_semi").select("day", "_id").distinct()
    deliveries = candidates.withColumn("_id", F.col("event.id")).join(members, ["day", "_id"], "left_semi").select(*EVENT.fieldNames())
    flat = keep(flat_events(dedupe_events(deliveries), settings).join(touched, ["source_ip", "slot"], "left_semi"), "events")

    near_days = _literal_days(near_slots, F.to_date(slot_start(F.col("slot"), settings)))
    near = read_days(spark, store.cells, SESSION_CELL).where(near_days).join(near_slots, ["source_ip", "slot"], "left_semi")
    affected = keep(near.select("source_ip", "session_start").distinct(), "affected")
    first_days = _literal_days(affected, F.to_date("session_start"))
    old_sessions = read_days(spark, store.sessions, SESSION).where(first_days).join(
        affected.withColumnRenamed("session_start", "start_time"), ["source_ip", "start_time"], "left_semi"
    )
    old_sessions = keep(old_sessions.select(*SESSION.fieldNames()), "stale-sessions")
    # A cell lies on the day its slot begins, which can be the day before its first event.
    spans = old_sessions.select(_days_between(slot_start(event_slot(F.col("start_time"), settings), settings), F.col("end_time")).alias("day"))
    covered = _literal_days(spans, F.col("day"))
    old_cells = read_days(spark, store.cells, SESSION_CELL).where(covered).join(affected, ["source_ip", "session_start"], "left_semi")
    old_cells = keep(old_cells.select(*SESSION_CELL.fieldNames()), "old-cells")

    names = [name for name in SESSION_CELL.fieldNames() if name not in ("session_start", "slot_time")]
    rest = old_cells.join(touched, ["source_ip", "slot"], "left_anti")
    chained = chain_cells(rest.select(*names).unionByName(session_cells(flat).select(*names)), settings)
    chained = keep(chained.withColumn("slot_time", slot_start(F.col("slot"), settings)).select(*SESSION_CELL.fieldNames()), "chained")
    old_paths = read_days(spark, store.paths, SESSION_PATH).where(covered)
    old_paths = keep(old_paths.join(old_cells.select("source_ip", "slot").distinct(), ["source_ip", "slot"], "left_semi").select(*SESSION_PATH.fieldNames()), "old-paths")
    paths = session_paths(flat).withColumn("slot_time", slot_start(F.col("slot"), settings)).select(*SESSION_PATH.fieldNames())
    keep(paths, "new-paths")
    all_paths = old_paths.join(touched, ["source_ip", "slot"], "left_anti").unionByName(paths).select("source_ip", "slot", "url")
    rebuilt = keep(merge_cells(chained, all_paths, settings), "sessions")

    old_found = read_days(spark, store.detections, DETECTION).where(first_days).join(affected, ["source_ip", "session_start"], "left_semi")
    old_found = keep(old_found.select(*DETECTION.fieldNames()), "stale-detections")
    found = keep(keep_first_seen(detect(rebuilt, settings=settings), old_found), "detections")
    return {
        "sessions": rebuilt.count(), "detections": found.count(), "events_read": flat.count(), "cells_read": old_cells.count(),
    }


def process_batch(spark: SparkSession, batch: DataFrame, batch_id: int, store: Store, settings: Settings = DEFAULTS) -> dict[str, int]:
    """Store the batch, then bring sessions and detections up to date from their mergeable cells.

    Sessions are never rebuilt from their events: the stored state is one small row per source, slot and
    touched names, and only slots that the batch touches are summed up again. What changes is
    written to a redo folder first and then applied by upserts, so a batch that is replayed after a failure, at
    whatever point, ends the same. Sessions that late events merged away leave the tables.
    """
    redo = Redo(spark, store, f"{stream_writer(batch)}-{batch_id}")
    if not redo.complete():
        redo.clear()
        write_batch(dedupe_events(batch), store.events, batch_id, stream_writer(batch))
        redo.finish(_plan_changes(spark, batch, store, redo, settings))
    counts = redo.counts()
    touched = redo.read("touched", _TOUCHED)
    old_cells, chained = redo.read("old-cells", SESSION_CELL), redo.read("chained", SESSION_CELL)
    moved = chained.alias("c").join(old_cells.join(touched, ["source_ip", "slot"], "left_anti").alias("o"), _same_cell("c", "o"), "left_anti")
    in_touched = lambda rows: rows.join(touched, ["source_ip", "slot"], "left_semi")
    upsert(spark, redo.read("detections", DETECTION), store.detections, DETECTION, "detection_id", "session_start", redo.read("stale-detections", DETECTION))
    upsert(spark, redo.read("sessions", SESSION), store.sessions, SESSION, "session_id", "start_time", redo.read("stale-sessions", SESSION))
    upsert(spark, redo.read("new-paths", SESSION_PATH), store.paths, SESSION_PATH, ["source_ip", "slot", "url"], "slot_time", in_touched(redo.read("old-paths", SESSION_PATH)))
    upsert(spark, moved, store.cells, SESSION_CELL, CELL_KEYS, "slot_time", in_touched(old_cells))
    redo.clear()
    return counts


class Redo:
    """The tables of one batch's changes, kept until they are applied; a marker written last tells that they are whole."""

    def __init__(self, spark: SparkSession, store: Store, name: str):
        self._spark, self._path = spark, f"{store.root}/redo/{name}"

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self._path}/{name}")
        return self._spark.read.schema(df.schema).parquet(f"{self._path}/{name}")

    def read(self, name: str, schema: StructType) -> DataFrame:
        return self._spark.read.schema(schema).parquet(f"{self._path}/{name}").select(*schema.fieldNames())

    def finish(self, counts: dict[str, int]) -> None:
        self(self._spark.createDataFrame(list(counts.items()), _COUNTS), "whole")

    def complete(self) -> bool:
        return not read_or_empty(self._spark, f"{self._path}/whole", _COUNTS).isEmpty()

    def counts(self) -> dict[str, int]:
        return {row.name: row.value for row in self.read("whole", _COUNTS).collect()}

    def clear(self) -> None:
        delete_path(self._spark, self._path)


def _same_cell(a: str, b: str) -> Column:
    """The same key and the same session; keys can be null."""
    equal = [F.col(f"{a}.{name}").eqNullSafe(F.col(f"{b}.{name}")) for name in (*CELL_KEYS, "session_start")]
    return reduce(Column.__and__, equal)


_TOUCHED = StructType([StructField("source_ip", StringType()), StructField("slot", LongType())])
_COUNTS = StructType([StructField("name", StringType()), StructField("value", LongType())])


def process_stream(
    events: DataFrame,
    store: Store,
    checkpoint: str,
    settings: Settings = DEFAULTS,
    available_now: bool = False,
    report: Callable[[int, dict[str, int]], None] | None = None,
) -> StreamingQuery:
    """Run `process_batch` on every micro-batch of canonical events."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        written = process_batch(batch.sparkSession, batch, batch_id, store, settings)
        if report is not None:
            report(batch_id, written)

    writer = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
