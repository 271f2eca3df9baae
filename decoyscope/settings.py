"""Tunable parameters and session configuration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    # Defaults that decide results.
    session_timeout_seconds: int = 300
    brute_force_threshold: int = 5
    web_enumeration_threshold: int = 4
    multi_service_threshold: int = 3
    settle_timeout_seconds: float = 25.0
    settle_quiet_seconds: float = 3.0
    step_tolerance_seconds: float = 2.0
    lab_subnet: str = "192.168.50.0/24"

    # Physical knobs: they change the plan, never the result.
    spread: int = 16
    match_slot_seconds: int = 3600


DEFAULTS = Settings()

# A broadcast side passes through the driver in several copies, and a scored run joins some ten tables at once.
BROADCAST_BYTES = 1 << 20


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options every job of this package relies on."""
    options = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        # Runs and sessions take some ten times their Parquet size as rows; without this, tables of 100 MB pass for broadcastable.
        "spark.sql.sources.fileCompressionFactor": "10",
        # State of streams off the heap; a batch uploads its changes only.
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    for key, value in options.items():
        spark.conf.set(key, value)
    # A session may allow smaller broadcasts or none (-1), never larger ones.
    allowed = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if allowed > BROADCAST_BYTES:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(BROADCAST_BYTES))
    return spark
