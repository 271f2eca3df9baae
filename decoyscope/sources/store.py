"""Parquet tables: daily partitions, keyed upserts, absent tables read as empty, additive schemas."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decoyscope.operators.evaluation import export_rows
from decoyscope.plans.skew import latest_per_key
from decoyscope.plans.tables import Scratch, delete_path, path_exists
from decoyscope.schemas import GROUND_TRUTH, RESOURCE_CSV


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, or no rows when its path does not exist; any other error propagates."""
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Old rows under a newer schema: absent columns become null, extra columns are kept last."""
    present = set(df.columns)
    known = [
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ]
    names = {f.name for f in schema.fields}
    return df.select(*known, *[name for name in df.columns if name not in names])


def stream_writer(batch: DataFrame) -> str:
    """The running stream's id, which lives in its checkpoint: the same after a restart, another for every other stream."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"


PARTS = ("event_date", "writer", "batch_id")


def write_batch(df: DataFrame, path: str, batch_id: int, writer: str, order: Sequence[str] = (), options: dict[str, str] | None = None) -> None:
    """Idempotent append of one micro-batch: replaying a writer's batch replaces exactly that batch's files.

    Batch ids begin at 0 in every stream, so the writer is part of the partition: several streams, or a
    stream that begins anew with a new checkpoint, share a table without touching each other's rows. Files are sorted by `order`.
    """
    rows = df.withColumns({"writer": F.lit(writer), "batch_id": F.lit(batch_id).cast("bigint")})
    if order:  # partition columns first: the writer would sort by them alone otherwise
        rows = rows.sortWithinPartitions(*PARTS, *order)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**(options or {})).partitionBy(*PARTS).parquet(path)


def _finish_compaction(spark: SparkSession, path: str) -> None:
    """End a compaction, or one that stopped halfway: written in full, what it merged goes; otherwise what it wrote."""
    root = path.rstrip("/")
    if path_exists(spark, f"{root}/_compaction/plan/_SUCCESS"):
        written = path_exists(spark, f"{root}/_compaction/written/_SUCCESS")
        for row in spark.read.schema(_PLAN).parquet(f"{root}/_compaction/plan").toLocalIterator():
            writer, batch = (row.writer, row.batch_id) if written else (COMPACTED, row.target)
            delete_path(spark, f"{root}/event_date={row.day}/writer={writer}/batch_id={batch}")
    delete_path(spark, f"{root}/_compaction")


def compact_days(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    before: Column,
    cluster: Sequence[str],
    one_row: Callable[[DataFrame], DataFrame] | None = None,
    lookup: str | None = None,
) -> None:
    """Rewrite all days before `before` that have several batches as one partition each, in one job, and drop the merged batches.

    No stream may write such a day, or have still to read it, any more. `one_row` reduces copies. Files are cut and sorted by
    `cluster`, so their minima and maxima tell which ones a filter on it can skip, however many rows one value has;
    `lookup` gets a Bloom filter per row group. A plan written beforehand lists what is merged: a repeat after a
    failure first ends or takes back what was begun, so no row is merged twice. Until the merged batches are gone, a
    reader of such a day sees its rows in both.
    """
    root = path.rstrip("/")
    _finish_compaction(spark, path)
    full = T.StructType([*schema.fields, T.StructField("writer", T.StringType()), T.StructField("batch_id", T.LongType())])
    held = read_or_empty(spark, path, full).where(F.col("event_date") < before)
    batches = held.select(*PARTS).distinct()
    several = batches.withColumn("_n", F.count("*").over(Window.partitionBy("event_date"))).where("_n > 1")
    target = batches.agg(F.max(F.when(F.col("writer") == COMPACTED, F.col("batch_id"))).alias("last")).first().last
    target = 0 if target is None else target + 1
    plan = several.select(F.date_format("event_date", "yyyy-MM-dd").alias("day"), F.lit(target).cast("bigint").alias("target"), "writer", "batch_id")
    plan.coalesce(1).write.parquet(f"{root}/_compaction/plan")
    days = [row.day for row in spark.read.schema(_PLAN).parquet(f"{root}/_compaction/plan").select("day").distinct().toLocalIterator()]  # a list of days
    if days:
        rows = held.where(F.col("event_date").isin([F.lit(day).cast("date") for day in days])).select(*schema.fieldNames())
        with Scratch(spark) as keep:
            merged = keep(one_row(rows), "days") if one_row else rows  # written down before it is sampled for the ranges
            bloom = {f"parquet.bloom.filter.enabled#{lookup}": "true"} if lookup else {}
            write_batch(merged.repartitionByRange("event_date", *cluster), path, target, COMPACTED, cluster, bloom)
        spark.range(1).coalesce(1).write.parquet(f"{root}/_compaction/written")
    _finish_compaction(spark, path)


_PLAN = "day string, target long, writer string, batch_id long"
COMPACTED = "compacted"


def upsert(
    spark: SparkSession,
    new: DataFrame,
    path: str,
    schema: T.StructType,
    key: str | Sequence[str],
    partition_source: str,
    stale: DataFrame | None = None,
) -> None:
    """Replace rows by key, rewriting only the daily partitions that new or stale rows touch.

    `stale` rows leave the table unless `new` brings their key back. The partition is a function
    of the row's immutable start, so a key never changes partition. `new` and `stale` are written
    down first: they may be derived from the table that is being rewritten.
    """
    names = schema.fieldNames()
    day = F.to_date(partition_source).alias("day")
    changes = new.select(*names, day, F.lit(1).alias("_version"), F.lit(True).alias("_keep"))
    if stale is not None:
        changes = changes.unionByName(stale.select(*names, day, F.lit(0).alias("_version"), F.lit(False).alias("_keep")))
    with Scratch(spark) as keep:
        changes = keep(changes, "upsert")
        text = F.date_format("day", "yyyy-MM-dd").alias("day")
        days = [row.day for row in changes.select(text).distinct().collect()]  # the days of one batch
        # Days as literals: only their partitions are listed and read.
        touched = read_days(spark, path, schema).where(F.col("day").isin([F.lit(day).cast("date") for day in days]))
        previous = touched.select(*names, "day", F.lit(-1).alias("_version"), F.lit(True).alias("_keep"))
        merged = latest_per_key(previous.unionByName(changes), ["day", *([key] if isinstance(key, str) else key)], ["_version"]).where("_keep").drop("_version", "_keep")
        # A written table first, then the swap: a day that lost all its rows is emptied as well.
        merged = keep(merged, "merged")
        _replace_days(spark, merged, days, path, schema)


def _replace_days(spark: SparkSession, rows: DataFrame, days: Sequence[str], path: str, schema: T.StructType) -> None:
    """The given days of a keyed table hold exactly `rows`, a written table; a day without rows is emptied."""
    left = {row.day for row in rows.select(F.date_format("day", "yyyy-MM-dd").alias("day")).distinct().collect()}
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    for day in set(days) - left:
        blank = spark.createDataFrame([], schema)
        blank.write.mode("overwrite").parquet(f"{path.rstrip('/')}/day={day}")


def delete_rows(spark: SparkSession, path: str, schema: T.StructType, unwanted: Column) -> None:
    """Delete rows from a keyed table by rewriting only the days that hold any, without a shuffle.

    A null condition keeps its row. Days are found from the columns that the condition reads. A failure halfway leaves
    some days done and the others as they were; the same call again finishes, and rewrites nothing once all are done.
    """
    rows, gone = read_days(spark, path, schema), F.coalesce(unwanted, F.lit(False))
    days = [row.day for row in rows.where(gone).select(F.date_format("day", "yyyy-MM-dd").alias("day")).distinct().collect()]  # a list of days
    if days:
        with Scratch(spark) as keep:
            kept = keep(rows.where(F.col("day").isin([F.lit(day).cast("date") for day in days]) & ~gone), "kept")
            _replace_days(spark, kept, days, path, schema)


def read_days(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A keyed table with its partition column `day`."""
    return read_or_empty(spark, path, T.StructType([*schema.fields, T.StructField("day", T.DateType())]))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Run summaries, one JSON document per file."""
    return spark.read.schema(GROUND_TRUTH).option("multiLine", True).json(path)


def read_resources(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Resource CSV as text columns; cells are typed, and bad ones counted, by the summary."""
    return spark.read.schema(RESOURCE_CSV).option("header", True).option("enforceSchema", False).csv(
        list(paths) if not isinstance(paths, str) else paths
    )


def export_csv(scored: DataFrame, path: str) -> None:
    export_rows(scored).write.mode("overwrite").option("header", True).csv(path)


def export_json(scored: DataFrame, path: str) -> None:
    export_rows(scored).write.mode("overwrite").option("ignoreNullFields", False).json(path)
