"""Stored quantile sketches: daily sketches of run measurements that batches add to and every window is merged from."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from decoyscope.operators.evaluation import COHORT
from decoyscope.plans.tables import Scratch
from decoyscope.sources.store import compact_days, read_or_empty, stream_writer, write_batch

SKETCH_SIZE = 1024  # a sketch of fewer samples holds all of them; a larger one is off by about 0.3 % of the ranks
PERCENTS = {"p50": 0.5, "p95": 0.95}

KEYS = (COHORT, "scenario_id", "measurement")
_DAY = T.StructField("event_date", T.DateType())
_BATCH = [T.StructField("writer", T.StringType()), T.StructField("batch_id", T.LongType())]
SKETCHED_RUNS = T.StructType([T.StructField("experiment_id", T.StringType()), _DAY])
SKETCHES = T.StructType([*[T.StructField(name, T.StringType()) for name in KEYS], T.StructField("sketch", T.BinaryType()), _DAY])


@dataclass(frozen=True)
class QuantileStore:
    """Paths of the sketch tables; each batch adds one partition per day to both of them."""

    root: str

    @property
    def runs(self) -> str:
        """Ids of the runs whose samples are in a sketch."""
        return f"{self.root}/sketched_runs"

    @property
    def sketches(self) -> str:
        return f"{self.root}/quantile_sketches"


def sketch_batch(samples: DataFrame, batch_id: int, store: QuantileStore) -> None:
    """Add one micro-batch of samples: (experiment_id, event_date, cohort, scenario_id, measurement, sample).

    All samples of a run come in one batch, under the day of the run's end. A sketch does not forget, so the first batch with a
    run counts and a run that comes again is left out: it is looked up among the ids of its own days only. Both writes
    replace only this batch and the lookup leaves this batch out, so a replay ends the same. Null and
    non-finite samples and rows without a day are not sketched. Sketches of a key are built map-side, so a scenario that holds
    most samples sends one sketch per task.
    """
    spark, writer = samples.sparkSession, stream_writer(samples)
    with Scratch(spark) as keep:
        new = keep(samples.where("event_date IS NOT NULL"), "samples")
        runs = new.select("experiment_id", "event_date").distinct()
        days = [row.day for row in runs.select(F.date_format("event_date", "yyyy-MM-dd").alias("day")).distinct().collect()]  # the days of one batch
        others = read_or_empty(spark, store.runs, T.StructType([*SKETCHED_RUNS.fields, *_BATCH])).where(
            F.col("event_date").isin([F.lit(day).cast("date") for day in days]) & ((F.col("writer") != writer) | (F.col("batch_id") != batch_id))
        )
        known = keep(others.select("experiment_id", "event_date").join(runs, ["experiment_id", "event_date"], "left_semi"), "known")
        value = F.col("sample")
        finite = new.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))
        fresh = finite.join(known, ["experiment_id", "event_date"], "left_anti")
        sketches = fresh.groupBy("event_date", *KEYS).agg(F.kll_sketch_agg_double("sample", F.lit(SKETCH_SIZE)).alias("sketch"))
        write_batch(sketches.coalesce(1), store.sketches, batch_id, writer)  # a row per day and key of the batch
        write_batch(runs.join(known, ["experiment_id", "event_date"], "left_anti"), store.runs, batch_id, writer)


def quantile_stream(samples: DataFrame, store: QuantileStore, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    def add(batch: DataFrame, batch_id: int) -> None:
        sketch_batch(batch, batch_id, store)

    running = samples.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    running = running.trigger(availableNow=True) if available_now else running.trigger(processingTime="10 seconds")
    return running.start()


def window_quantiles(
    spark: SparkSession, store: QuantileStore, days: int, keys: Sequence[str] = KEYS, percents: dict[str, float] = PERCENTS
) -> DataFrame:
    """(last_day, keys, count, one column per percent) of every window of `days` days that has samples.

    Merged from daily sketches: no run or event is read. Fewer `keys` merge over the others, such as all scenarios of a cohort.
    """
    daily = read_or_empty(spark, store.sketches, SKETCHES)
    ends = daily.select(*keys, "sketch", F.explode(F.sequence("event_date", F.date_add("event_date", days - 1))).alias("last_day"))
    merged = ends.groupBy("last_day", *keys).agg(F.kll_merge_agg_double("sketch").alias("_sketch"))
    return merged.select(
        "last_day", *keys, F.kll_sketch_get_n_double("_sketch").alias("count"),
        *[F.kll_sketch_get_quantile_double("_sketch", F.lit(p)).alias(name) for name, p in percents.items()],
    )


def rank_errors(samples: DataFrame, quantiles: DataFrame, keys: Sequence[str], percents: dict[str, float] = PERCENTS) -> DataFrame:
    """(keys, samples, rank_error): how far each estimate's true rank lies from the wanted one, as a share; the worst of `percents`.

    `samples` has the keys and a finite `sample`. An estimate that equals several samples covers all of their ranks.
    """
    joined = samples.join(quantiles.select(*keys, *percents), list(keys))
    counted = joined.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        *[F.count_if(F.col("sample") < F.col(name)).alias(f"_below_{name}") for name in percents],
        *[F.count_if(F.col("sample") <= F.col(name)).alias(f"_upto_{name}") for name in percents],
    )
    n = F.col("samples")
    errors = [F.greatest(F.col(f"_below_{name}") / n - F.lit(p), F.lit(p) - F.col(f"_upto_{name}") / n, F.lit(0.0)) for name, p in percents.items()]
    return counted.select(*keys, "samples", (F.greatest(*errors) if len(errors) > 1 else errors[0]).alias("rank_error"))


def compact_quantiles(spark: SparkSession, store: QuantileStore, before: Column) -> None:
    """One partition a day and one sketch a key for days before the given date."""

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy("event_date", *KEYS).agg(F.kll_merge_agg_double("sketch").alias("sketch"))

    compact_days(spark, store.sketches, SKETCHES, before, KEYS, merge)
    compact_days(spark, store.runs, SKETCHED_RUNS, before, ("experiment_id",), None, "experiment_id")
