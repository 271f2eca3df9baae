"""Streaming forms of the session rollup, the histogram and the settle watch."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from math import isqrt

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from decoyscope.functions.values import seconds_between
from decoyscope.operators.experiments import event_points
from decoyscope.operators.sessions import is_internal, session_window_rollup
from decoyscope.plans.skew import slot
from decoyscope.settings import DEFAULTS, Settings
from decoyscope.sources.store import stream_writer, write_batch


def session_stream(events: DataFrame, lateness: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Closed sessions, each emitted once when the watermark passes its end plus the timeout."""
    return session_window_rollup(events.withWatermark("ts", lateness), settings.session_timeout_seconds)


def histogram_stream(events: DataFrame, interval: str, lateness: str) -> DataFrame:
    """Tumbling event counts of external traffic."""
    counted = (
        events.where(~is_internal()).withWatermark("ts", lateness)
        .groupBy(F.window("ts", interval).alias("_w")).agg(F.count("*").alias("count"))
    )
    return counted.select(F.col("_w.start").alias("bucket"), "count")


def settle_watch(runs: DataFrame, arrivals: DataFrame, now: datetime | Column, settings: Settings = DEFAULTS) -> DataFrame:
    """State of every watched run at `now`: settled, timed_out or waiting."""
    instant = now if isinstance(now, Column) else F.lit(now)
    joined = runs.select("experiment_id", "end_time").join(arrivals, "experiment_id", "left")
    since_last = seconds_between(F.greatest("last_arrival", "end_time"), instant)
    waited = seconds_between(F.col("end_time"), instant)
    quiet = F.coalesce((F.col("matched_event_count") > 0) & (since_last >= settings.settle_quiet_seconds), F.lit(False))
    return joined.select(
        "experiment_id",
        F.when(quiet, "settled").when(waited >= settings.settle_timeout_seconds, "timed_out").otherwise("waiting").alias("state"),
        F.coalesce("matched_event_count", F.lit(0)).cast("bigint").alias("matched_event_count"),
    )


def run_arrivals(runs: DataFrame, events: DataFrame, longest_run: str, lateness: str, settings: Settings = DEFAULTS) -> DataFrame:
    """(experiment_id, end_time, ingested) of every event of a run, both sides being streams.

    Runs come in when they end. A run lasts at most `longest_run`, so an event is held for that long and a run
    until the events have passed its end. Equality is on the route, a part of a time slot and a salt: a run goes to each
    part it covers and to each salt, so neither a hot route nor a hot hour is one task's work or one key's state.
    A slot is still cut in `spread`, but a short run is held in the parts of the slot that it touches only.
    """
    salts = isqrt(settings.spread)
    width = settings.match_slot_seconds * 1_000_000 // (settings.spread // salts)
    points = event_points(events).withWatermark("ts", lateness).withColumns({
        "_slot": slot(F.col("ts"), width), "_salt": F.pmod(F.xxhash64("event_id"), F.lit(salts)).cast("int"),
    })
    covered = F.sequence(slot(F.col("start_time"), width), slot(F.col("end_time"), width))
    windows = (
        runs.where("start_time <= end_time").select("experiment_id", "attacker_ip", "target_ip", "target_honeypots", "start_time", "end_time")
        .withWatermark("end_time", lateness)
        .withColumn("_slot", F.explode(covered))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    keys = ("attacker_ip", "target_ip", "_slot", "_salt")
    p, w = points.alias("p"), windows.alias("w")
    targets = F.coalesce("w.target_honeypots", F.array().cast("array<string>"))
    within = (
        (F.col("p.ts") >= F.col("w.start_time")) & (F.col("p.ts") <= F.col("w.end_time"))
        & (F.col("w.end_time") <= F.col("p.ts") + F.expr(f"INTERVAL {longest_run}"))
    )
    for key in keys:
        within &= F.col(f"p.{key}") == F.col(f"w.{key}")
    return (
        p.join(w, within).where(((F.size(targets) == 0) | F.array_contains(targets, F.col("p.service"))) & F.col("p.ingested").isNotNull())
        .select("w.experiment_id", "w.end_time", "p.ingested")
    )


def edge_arrivals(arrivals: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The first and last arrival of each quiet-period slot after a run's end, and of the time before it.

    Gaps inside a slot never reach the quiet period, so these decide as all arrivals do; a hot run of
    any size is a few rows, combined before they are shuffled. Arrivals after the time limit decide nothing.
    """
    after = F.greatest(F.unix_micros("ingested") - F.unix_micros("end_time"), F.lit(0))
    edges = (
        arrivals.where(after <= int(settings.settle_timeout_seconds * 1e6))
        .groupBy("experiment_id", "end_time", F.floor(after / int(settings.settle_quiet_seconds * 1e6)).alias("_slot"))
        .agg(F.array(F.min("ingested"), F.max("ingested")).alias("_edges"))
    )
    return edges.select("experiment_id", "end_time", F.explode(F.array_distinct("_edges")).alias("ingested"))


def arrival_stream(arrivals: DataFrame, path: str, checkpoint: str, settings: Settings = DEFAULTS, available_now: bool = False) -> StreamingQuery:
    """Keep the edges of each batch of `run_arrivals` in a daily table that `settle_marks` reads as a stream.

    A replayed batch replaces its own files; copies it may leave for a reader decide nothing new. Old state of the join goes
    with the next batch of rows: a batch without rows would read all of it and give nothing.
    """
    spark = arrivals.sparkSession
    name = "spark.sql.streaming.noDataMicroBatches.enabled"

    def store(batch: DataFrame, batch_id: int) -> None:
        edges = edge_arrivals(batch, settings).withColumn("event_date", F.to_date("ingested"))
        write_batch(edges, path, batch_id, stream_writer(batch))

    writer = arrivals.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    before = spark.conf.get(name)
    spark.conf.set(name, "false")  # a stream keeps the options it is started with
    try:
        return writer.start()
    finally:
        spark.conf.set(name, before)


def settle_marks(arrivals: DataFrame, runs: DataFrame, lateness: str) -> DataFrame:
    """Input of settle_stream: a mark per run at its end, and one per matched arrival.

    `arrivals` has experiment_id, end_time and ingested, `runs` experiment_id and end_time; both are streams. Each has
    a watermark of its own and the slower one counts, so arrivals that are stored late do not find their run reported.
    A row without experiment_id is a heartbeat: it moves the watermark of its side and nothing else.
    """
    none = F.lit(None).cast("timestamp")
    ends = runs.where("end_time IS NOT NULL").select("experiment_id", "end_time", none.alias("ingested"), F.col("end_time").alias("seen_at"))
    seen = arrivals.where("ingested IS NOT NULL").select("experiment_id", "end_time", "ingested", F.col("ingested").alias("seen_at"))
    return ends.withWatermark("seen_at", lateness).unionByName(seen.withWatermark("seen_at", lateness))


class SettleTimer(StatefulProcessor):
    """One row per run when it settles or its time is up, told by a timer on the watermark.

    The state of a run is its end and its spans: first and last arrival of each quiet-period slot after the end, at
    most timeout / quiet + 2 of them. Spans merge in any order, so rows out of order within the watermark's
    delay change nothing. The timer stands at the first instant that could be the answer; once the watermark is past it no
    arrival can move it. A reported run is remembered until its time limit, after which no mark of it is let in.
    """

    STATE = "end_us long, spans array<long>, timer_ms long, done boolean"
    OUTPUT = "experiment_id string, telemetry_settled boolean, settle_wait_seconds double"

    def __init__(self, quiet_us: int, limit_us: int):
        self.quiet, self.limit = quiet_us, limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", self.STATE)

    def _answer(self, spans: list[int]) -> tuple[bool, int]:
        """Settled or not, and after how many microseconds, if nothing else arrives."""
        for last, following in zip(spans[1::2], [*spans[2::2], None]):
            if following is None or following - last > self.quiet:
                wait = last + self.quiet
                return (True, wait) if wait <= self.limit else (False, self.limit)
        return False, self.limit

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        end, spans, timer, done = self.run.get() or (None, [], None, False)
        if done:
            return iter(())
        slots = {first // self.quiet: (first, last) for first, last in zip(spans[::2], spans[1::2])}
        for row in rows:
            end = row.end_us if end is None else end
            if row.arrival_us is None:
                continue
            after = max(row.arrival_us - end, 0)
            if after <= self.limit:
                first, last = slots.get(after // self.quiet, (after, after))
                slots[after // self.quiet] = min(first, after), max(last, after)
        spans = [edge for slot in sorted(slots) for edge in slots[slot]]
        self._wait(end, spans, timer, end + self._answer(spans)[1], False)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        end, spans, timer, done = self.run.get()
        over = (end + self.limit) // 1000 + 1
        if done or over <= timerValues.getCurrentWatermarkInMs():
            self.run.clear()
        else:
            self._wait(end, [], None, end + self.limit, True)
        if done:
            return iter(())
        settled, wait = self._answer(spans)
        return iter([Row(experiment_id=key[0], telemetry_settled=settled, settle_wait_seconds=wait / 1e6)])

    def _wait(self, end: int, spans: list[int], timer: int | None, until_us: int, done: bool) -> None:
        due = until_us // 1000 + 1
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.run.update((end, spans, due, done))


def settle_stream(marks: DataFrame, lateness: str | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Each run once, when it settles or its time is up: (experiment_id, telemetry_settled, settle_wait_seconds).

    `lateness` is for marks without a watermark. Of repeated runs the first end that is seen counts; a run without an
    end is not watched. Needs the RocksDB state store, which `configure` sets.
    """
    quiet, limit = int(settings.settle_quiet_seconds * 1e6), int(settings.settle_timeout_seconds * 1e6)
    timed = marks.withWatermark("seen_at", lateness) if lateness else marks
    # The condition names seen_at, so it stays above the watermark, which all marks move.
    watched = F.when(F.col("experiment_id").isNotNull(), F.col("end_time"))
    inside = F.col("seen_at") <= watched + F.make_dt_interval(secs=F.lit(limit / 1e6))
    micros_of = {"end_us": F.unix_micros("end_time"), "arrival_us": F.unix_micros("ingested")}
    keyed = timed.where(inside).select("experiment_id", "seen_at", *[column.alias(name) for name, column in micros_of.items()])
    return keyed.groupBy("experiment_id").transformWithState(SettleTimer(quiet, limit), SettleTimer.OUTPUT, "append", "EventTime")


def run_metrics(query: StreamingQuery) -> dict[str, object]:
    """Last run, rows read and last error of a running query."""
    progress = query.lastProgress
    failure = query.exception()
    return {
        "last_run": progress["timestamp"] if progress else None,
        "batch_id": progress["batchId"] if progress else None,
        "rows_read": progress["numInputRows"] if progress else 0,
        "last_error": str(failure) if failure else None,
    }
