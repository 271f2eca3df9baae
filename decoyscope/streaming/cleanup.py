"""Cleanup of derived rows of internal sources in stored tables: a dry run first, then a delete that rewrites touched days only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decoyscope.functions.ip import is_loopback
from decoyscope.operators.analytics import internal_derived_counts
from decoyscope.schemas import DETECTION, SESSION, SESSION_CELL, SESSION_PATH
from decoyscope.sources.store import delete_rows, read_days
from decoyscope.streaming.processor import Store


def derived_tables(store: Store) -> dict[str, tuple]:
    """Path and schema of every stored table that is derived from events, by name."""
    return {
        "sessions": (store.sessions, SESSION), "detections": (store.detections, DETECTION),
        "session_cells": (store.cells, SESSION_CELL), "session_paths": (store.paths, SESSION_PATH),
    }


def internal_rows(spark: SparkSession, store: Store) -> DataFrame:
    """The dry run: (table_name, rows) that `clean_store` would delete. Absent tables have none."""
    return internal_derived_counts(**{name: read_days(spark, path, schema) for name, (path, schema) in derived_tables(store).items()})


def clean_store(spark: SparkSession, store: Store) -> None:
    """Delete every derived row with a loopback source; rows without a source stay.

    State goes last, so a run that stopped halfway leaves nothing that a later batch would build on unseen: the same
    call again finishes it. Stop the processor first, for both write the same days.
    """
    for path, schema in derived_tables(store).values():
        delete_rows(spark, path, schema, is_loopback(F.col("source_ip")))
