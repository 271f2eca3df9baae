"""Intermediate results as written tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; a temporary folder only on a local master that sets none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_folder()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="decoyscope-")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: ends the lineage, survives lost executors, keeps column pruning.

    For results that several later steps read, such as matched events or scored runs.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Spark's own file system layer, wherever it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target))


class Scratch:
    """Intermediate tables of one unit of work, such as a micro-batch; its folder goes when the work ends.

    with Scratch(spark) as keep:
        small = keep(df, "horizons")
    """

    def __init__(self, spark: SparkSession):
        self._spark, self._path = spark, f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self._path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        delete_path(self._spark, self._path)
