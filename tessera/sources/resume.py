"""Output that a later run goes on with, without reading it again.

Each batch of rows is a folder of JSON lines; beside it lie its keys as a narrow table, and Bloom filters of them. Rows that no filter knows are new and stay where
they are; only those that some filter may know are exchanged for an exact anti join with the keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import tables as T

PROBES = 7


def positions(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    """(keys, PROBES): the bits of each key, by double hashing."""
    nth = np.arange(PROBES, dtype=np.uint64)
    return ((h1.view(np.uint64)[:, None] + nth * (h2.view(np.uint64)[:, None] | np.uint64(1))) % np.uint64(bits)).astype(np.int64)


class ResumableOutput:
    """Rows at ``path`` by batches, known by ``key``.

    A filter has ``bits`` bits for about ``per`` keys. Filters go to the tasks together as long as they have at most ``most`` bytes; an output with more is joined whole, which
    gives the same rows. A batch whose run ended before its keys were written is indexed when the output is opened again. Rows with a null key are never done.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, kind: str = "string", per: int = 500_000, bits: int = 1 << 23, most: int = 64 << 20):
        self.spark, self.path, self.key, self.kind = spark, path.rstrip("/"), key, kind
        self.per, self.bits, self.most = per, bits, most

    def _named(self, folder: str) -> set[str]:
        return {n.removeprefix("batch=") for n in T.children(self.spark, folder) if n.startswith("batch=")}

    def write(self, df: DataFrame) -> str:
        """Adds a batch; its keys and filters follow the rows."""
        name = uuid.uuid4().hex
        df.write.json(f"{self.path}/batch={name}")
        self._index(name)
        return name

    def _hashed(self, df: DataFrame) -> DataFrame:
        return df.withColumns({"_h1": F.xxhash64(F.col(self.key).cast("string")), "_h2": F.xxhash64(F.lit(0x5EED), F.col(self.key).cast("string"))})

    def _index(self, name: str) -> None:
        draft = f"{self.path}/_drafts/{name}"
        T.remove(self.spark, draft)
        keys = self.spark.read.schema(f"{self.key} {self.kind}").json(f"{self.path}/batch={name}").where(F.col(self.key).isNotNull()).distinct()
        keys.write.parquet(f"{draft}/keys")
        keys = self.spark.read.parquet(f"{draft}/keys")
        parts = max(1, -(-keys.count() // self.per))
        bits = self.bits

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters: dict[int, np.ndarray] = {}
            for batch in batches:
                part, h1, h2 = (batch.column(c).to_numpy() for c in ("part", "_h1", "_h2"))
                for p in np.unique(part):
                    own = part == p
                    filters.setdefault(int(p), np.zeros(bits, bool))[positions(h1[own], h2[own], bits).ravel()] = True
            for p, told in filters.items():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(told).tobytes()], pa.binary())], names=["part", "filter"])

        hashed = self._hashed(keys).select(F.pmod("_h1", F.lit(parts)).cast("int").alias("part"), "_h1", "_h2")
        filters = hashed.repartition(parts, "part").mapInArrow(build, "part int, filter binary").withColumn("parts", F.lit(parts))
        filters.write.parquet(f"{draft}/filters")
        T.make(self.spark, f"{self.path}/_done")
        T.rename(self.spark, draft, f"{self.path}/_done/batch={name}")

    def _ready(self) -> list[str]:
        """The batches, all of them with their keys."""
        names = self._named(self.path)
        for name in names - self._named(f"{self.path}/_done"):
            self._index(name)
        return sorted(names)

    def keys(self) -> DataFrame:
        """The keys done, from their own tables."""
        names = self._ready()
        shape = f"{self.key} {self.kind}"
        if not names:
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(shape).parquet(*(f"{self.path}/_done/batch={n}/keys" for n in names))

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """(rows that are surely new, rows that may be done); all are of the second kind where the filters are too large, none where nothing is done."""
        names = self._ready()
        if not names:
            return df, None
        told = self.spark.read.parquet(*(f"{self.path}/_done/batch={n}/filters" for n in names))
        told = told.withColumn("batch", F.regexp_extract(F.input_file_name(), "batch=([0-9a-f]+)", 1))
        size = told.agg(F.sum(F.length("filter"))).first()[0] or 0
        if size > self.most:
            return df.limit(0), df
        filters: dict[tuple[str, int], dict[int, np.ndarray]] = {}
        for r in told.collect():  # at most ``most`` bytes, as just counted
            filters.setdefault((r["batch"], r["parts"]), {})[r["part"]] = np.unpackbits(np.frombuffer(r["filter"], np.uint8)).astype(bool)
        shared = self.spark.sparkContext.broadcast(filters)
        names_, bits = df.columns, self.bits

        @F.pandas_udf("boolean")
        def may(h1, h2):
            import pandas as pd

            a, b = h1.to_numpy(np.int64), h2.to_numpy(np.int64)
            found, at = np.zeros(len(a), bool), positions(a, b, bits)
            for (_, parts), own in shared.value.items():
                part = (a % parts).astype(np.int64)
                for p in np.unique(part):
                    if p in own:
                        rows = np.flatnonzero(part == p)
                        found[rows] |= own[p][at[rows]].all(axis=1)
            return pd.Series(found)

        flagged = self._hashed(df)
        known = F.col(self.key).isNotNull() & may(F.col("_h1"), F.col("_h2"))
        return flagged.where(~known).select(*names_), flagged.where(known).select(*names_)

    def remaining(self, df: DataFrame) -> DataFrame:
        """Rows whose key is not done."""
        new, maybe = self.split(df)
        if maybe is None:
            return new
        return new.unionByName(maybe.join(self.keys(), self.key, "left_anti").select(*df.columns))
