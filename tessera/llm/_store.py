"""Intermediate tables in the folder that the whole cluster shares, and Arrow iteration over groups of sorted rows."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
SMALL_BYTES = 32 << 20

_own: dict[str, str] = {}
_written: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the cluster names it; only where it is unset and Spark runs in one process a folder of this process."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    inner = spark.sparkContext._jsc.sc().getCheckpointDir()
    if inner.isDefined():
        return inner.get().rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _own:
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own["dir"] = f"file://{folder}"
    return _own["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def clear(spark: SparkSession) -> None:
    """Deletes what this process has written to the shared folder and not deleted yet; results that still read it then fail."""
    for path in list(_written):
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    _written.discard(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


BRIEF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it Spark deletes a query's shuffle files when the query ends, by a setting of its own: for queries that run once."""
    before = spark.conf.get(BRIEF)
    spark.conf.set(BRIEF, "true")
    try:
        yield
    finally:
        spark.conf.set(BRIEF, before)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def replace(spark: SparkSession, draft: str, path: str) -> None:
    """Renames a folder over another. What stood there is kept until the new one is in its place."""
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    old = f"{path}-{uuid.uuid4().hex}"
    store = kind(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = store.exists(kind(path))
    if there and not store.rename(kind(path), kind(old)) or not store.rename(kind(draft), kind(path)):
        raise OSError(f"{path} could not be replaced")
    if there:
        store.delete(kind(old), True)


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of the session hold at most BATCH_BYTES, as each lies in the JVM and in Python at once for every task of an
    executor. A smaller setting stays. It outlives the call, because results are computed later."""
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_CONF)) > BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def few_files(df: DataFrame) -> DataFrame:
    """``df`` in few partitions if the largest table that its plan reads has at most SMALL_BYTES, which a handful of tasks can hold: two for each
    core, or an eighth of the shuffle partitions if those are more. A larger one stays as adaptive execution deals it, by bytes."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    if any(int(leaves.apply(i).stats().sizeInBytes()) > SMALL_BYTES for i in range(leaves.size())):
        return df
    spark = df.sparkSession
    return df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


def unused(names: Iterable[str], stem: str) -> str:
    """``stem``, lengthened until none of ``names`` equals it, upper or lower case."""
    taken = {n.lower() for n in names}
    while stem.lower() in taken:
        stem += "_"
    return stem


class Kept:
    """Tables written to the shared folder: they cut lineage and survive lost executors. ``drop`` deletes one early.

    Small tables are merged to ``few_files``. ``whole`` keeps the partitions as they are also of small ones: those of a scan, which
    follow the input, and of rows that tell the number of their task.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def put(self, df: DataFrame, name: str, whole: bool = False) -> DataFrame:
        path = new_path(self.spark, name)
        small_batches(self.spark)
        (df if whole else few_files(df)).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessera_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := getattr(df, "_tessera_path", None):
                delete(self.spark, path)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) for each run of equal keys in sorted batches. Runs that end inside a batch are sliced, not copied."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in cols)
            if last is not None and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if last is not None:
        yield last, pa.Table.from_batches(held)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, first row of each run and the end) for many runs of equal keys at once, ``least`` rows or more but for the last; no run is parted."""
    held: list[pa.RecordBatch] = []
    size = 0

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        new[:1] = True
        for c in (table.column(k).to_numpy() for k in keys):
            new[1:] |= c[1:] != c[:-1]
        return np.append(np.flatnonzero(new), len(table))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < least:
            continue
        table = pa.Table.from_batches(held)
        cuts = starts(table)
        if len(cuts) > 2:
            yield table.slice(0, cuts[-2]), cuts[:-1]
            held = table.slice(cuts[-2]).combine_chunks().to_batches()
            size = sum(b.num_rows for b in held)
    if size:
        table = pa.Table.from_batches(held)
        yield table, starts(table)
