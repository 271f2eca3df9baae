"""Sensor JSON lines: batch and streaming scans that keep the exact line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decoyscope.functions.values import parse_time
from decoyscope.schemas import RAW


def _with_sensor(lines: DataFrame, sensor_id: str, sensor_ip: str, honeypot_id: str | None, honeypot_type: str | None):
    def text(value: str | None) -> Column:
        return F.lit(value).cast("string")

    return lines.withColumns(
        {
            "sensor_id": text(sensor_id),
            "sensor_ip": text(sensor_ip),
            "honeypot_id": text(honeypot_id),
            "honeypot_type": text(honeypot_type),
        }
    )


def read_lines(
    spark: SparkSession,
    paths: str | Sequence[str],
    sensor_id: str,
    sensor_ip: str,
    honeypot_id: str | None = None,
    honeypot_type: str | None = None,
) -> DataFrame:
    """Lines of one sensor input with the shipper's columns; blank lines are dropped."""
    lines = spark.read.text(list(paths) if not isinstance(paths, str) else paths).where(F.col("value").rlike(r"\S"))
    return _with_sensor(lines, sensor_id, sensor_ip, honeypot_id, honeypot_type)


def stream_lines(
    spark: SparkSession,
    directory: str,
    sensor_id: str,
    sensor_ip: str,
    honeypot_id: str | None = None,
    honeypot_type: str | None = None,
    max_files_per_trigger: int = 1000,
) -> DataFrame:
    """The same scan as a stream over a directory that keeps receiving files."""
    lines = (
        spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger)
        .text(directory)
        .where(F.col("value").rlike(r"\S"))
    )
    return _with_sensor(lines, sensor_id, sensor_ip, honeypot_id, honeypot_type)


def read_sensor_lines(spark: SparkSession, paths: str | Sequence[str], sensors: DataFrame) -> DataFrame:
    """Lines of many sensor inputs at once, each with the shipper's columns of the folder it lies in."""
    return enrich_by_path(_with_path(spark.read.text(list(paths) if not isinstance(paths, str) else paths)), sensors)


def stream_sensor_lines(spark: SparkSession, paths: str, sensors: DataFrame, max_files_per_trigger: int = 1000) -> DataFrame:
    """The same as one stream over folders (a glob) that keep receiving files."""
    return enrich_by_path(_with_path(spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(paths)), sensors)


def _with_path(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("value").rlike(r"\S")).select("value", F.col("_metadata.file_path").alias("file_path"))


def enrich_by_path(lines: DataFrame, sensors: DataFrame) -> DataFrame:
    """Shipper columns from a sensors table (directory, sensor_id, sensor_ip, honeypot_id, honeypot_type).

    `lines` carries `_metadata.file_path` as `file_path`; a plain equi join, so Spark broadcasts
    the table only while it is under the broadcast threshold.
    """
    directory = F.regexp_extract("file_path", r"^(?:[a-z]+:/*)?(/.*)/[^/]*$", 1)
    return lines.withColumn("directory", directory).join(sensors, "directory", "left").drop("directory", "file_path")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Add `raw` (typed object) and `parse_failed` (not an object, broken JSON or no timestamp).

    The one-element explode keeps the parse in its own step: Catalyst would otherwise inline the
    JSON parser into every expression that reads a field.
    """
    parsed = F.struct(F.from_json("value", RAW).alias("raw"), F.try_parse_json("value").isNull().alias("broken"))
    no_time = F.coalesce(F.col("_p.raw")["timestamp"], F.col("_p.raw")["@timestamp"]).isNull()
    return (
        lines.withColumn("_p", F.explode(F.array(parsed)))
        .withColumn("raw", F.col("_p.raw"))
        .withColumn("parse_failed", no_time | F.col("_p.broken"))
        .drop("_p")
    )


def occurred_at(raw: Column) -> Column:
    return parse_time(F.coalesce(raw["timestamp"], raw["@timestamp"]))
