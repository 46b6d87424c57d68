"""Cutting lineage by tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; one of our own only in local mode, where it may be unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str = "step") -> tuple[DataFrame, str]:
    """df written to the shared folder and read back, and its path, for ``drop`` when no plan reads it any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the shared folder and read back; a lost executor loses nothing."""
    return written(df, name)[0]


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that no plan reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: The most rows that one task of a large exchange is to hold.
ROWS = 1_000_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by its keys to as many tasks as ``rows`` rows need, at least the session's own number: a task's memory stays as tables grow."""
    spark = df.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(max(least, -(-rows // ROWS)), *keys)


class Levels:
    """The levels of a loop as one table with a column for the level's number: plans of later levels read one scan, whatever their number, and when
    the loop ends the table is its result."""

    def __init__(self, spark: SparkSession, number: str, name: str = "levels"):
        self.spark, self.number, self.path, self.schema = spark, number, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", None

    def add(self, df: DataFrame, number: int) -> DataFrame:
        """df written as a level and read back."""
        path = f"{self.path}/{self.number}={number}"
        df.write.parquet(path)
        self.schema = self.schema or df.schema
        return self.spark.read.schema(df.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField(self.number, IntegerType())])).parquet(self.path)


class Scratch:
    """Owns the written tables of one query: all go when the block ends, but for what ``result`` wrote.

    A query's last step is written by ``result``, which its caller's plan reads; what led to it is of no use any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        drop(self.spark, *self.paths)

    def keep(self, df: DataFrame, name: str = "step") -> DataFrame:
        df, path = written(df, name)
        self.paths.append(path)
        return df

    def result(self, df: DataFrame, name: str = "result") -> DataFrame:
        return written(df, name)[0]


def filesystem(path: str):
    """Arrow's file system for a shared path, and the path in it; for page and package files that Spark's writers don't make."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(path) if ":" in path else (LocalFileSystem(), path)
