"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.session import ensure_checkpoints


class Tables:
    """Parquet tables of one computation. They cut lineage and outlive lost executors; ``drop`` deletes one that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        ensure_checkpoints(spark)
        self.folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tables-{uuid.uuid4().hex}"
        self.number = 0

    def put(self, df: DataFrame, *by: str, compression: str | None = None) -> DataFrame:
        """``df`` as written, in folders by the values of ``by``, so that a filter on them reads no more than it asks for; ``compression`` names another than the session's."""
        self.number += 1
        path = f"{self.folder}/{self.number}"
        df.write.partitionBy(*by).parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tables_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_tables_path", None)
        if path:
            remove(self.spark, path)

    def clear(self) -> None:
        """Deletes all of them."""
        remove(self.spark, self.folder)


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    target, store = _path(spark, path)
    store.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target, store = _path(spark, path)
    return store.exists(target)


def make(spark: SparkSession, path: str) -> None:
    target, store = _path(spark, path)
    store.mkdirs(target)


def rename(spark: SparkSession, old: str, new: str) -> None:
    target, store = _path(spark, old)
    if not store.rename(target, _path(spark, new)[0]):
        raise OSError(f"{new} is there already")


def children(spark: SparkSession, path: str) -> list[str]:
    target, store = _path(spark, path)
    return [str(f.getPath().getName()) for f in store.listStatus(target)] if store.exists(target) else []
