"""What the training-data operators share: reading tables, cutting lineage, row keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; a temporary folder only on a local master that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read back: later steps see only the columns they use."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(rows: DataFrame) -> DataFrame:
    """Joined by a shuffle, never broadcast through the driver: Spark's size estimate leaves out what explode repeats and how far files unpack."""
    return rows.hint("merge")


def row_key(text: Column, *more: Column) -> Column:
    """Names a row by its content: rows that share it are equal in what an operator reads."""
    return F.xxhash64(F.coalesce(text, F.lit("")), *more)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Total UTF-8 size of a text column; one number, for choosing how many parts a job needs."""
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def about(rows: DataFrame, limit: int, *keys: Column) -> DataFrame:
    """About `limit` rows, or all if there are not more: those whose keys hash below a limit's share of all hashes.

    A filter on every row; only the number of rows passes the driver.
    """
    number = rows.count()
    if number <= limit:
        return rows
    return rows.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) < int(limit / number * (1 << 40)))
