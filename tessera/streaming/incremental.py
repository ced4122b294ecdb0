"""Incremental gating and deduplication of a stream of generated instructions.

Our extension: the corpus's batch loop as Structured Streaming. Each micro-batch is gated, reduced to one row for each key, and
kept where its key is new and its nearest accepted instruction is far enough; accepted rows are appended under the
batch's number, so that a batch that is run again replaces its own output and nothing else. Vectors of accepted rows lie in a growing collection, of
which a batch reads the cells in reach only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.models import hashed_embedding
from tessera.operators.gates import quality_gate
from tessera.operators.collection import VectorCollection
from tessera.operators.neighbours import greedy_select
from tessera.operators.stats import first_by_key

SCHEMA = "request_idx long, instruction string, input string, output string"
ACCEPTED = SCHEMA + ", id long, vector array<float>"


def accepted(spark: SparkSession, folder: str, before: int) -> DataFrame:
    """What earlier batches have accepted."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], ACCEPTED)
    return spark.read.schema(ACCEPTED + ", batch long").parquet(folder).where(F.col("batch") < before).drop("batch")


def accept(batch: DataFrame, number: int, folder: str, least: float = 0.3, language: str = "EN") -> None:
    """One micro-batch. Rows count in order of (request_idx, id): one that is near to a row accepted before it, in this batch or an earlier one, goes."""
    spark = batch.sparkSession
    key = F.concat_ws(" ### ", "instruction", "input")
    rows = first_by_key(quality_gate(batch, language=language), [key], F.struct("request_idx", "output"))
    old = accepted(spark, folder, number)
    rows = rows.withColumn("_k", key).join(old.select(key.alias("_k")), "_k", "left_anti").drop("_k")
    rows = hashed_embedding(rows.withColumn("id", F.xxhash64("instruction", "input")), "instruction", "vector").persist()
    try:
        far, known = rows, VectorCollection(spark, f"{folder}/_vectors")
        if least > 0:
            far = rows.join(known.near_ids(rows.select("id", "vector"), least, before=number), "id", "left_anti")
            far = greedy_select(far.withColumn("rank", F.struct("request_idx", "id")), least)
        out = f"{folder}/batch={number}"
        far.select(*[c.split()[0] for c in ACCEPTED.split(", ")]).write.mode("overwrite").parquet(out)
        if least > 0:
            new = spark.read.parquet(out).select("id", F.concat_ws("\n", "instruction", "input").alias("document"), "vector")
            known.append(new, "id", number)
    finally:
        rows.unpersist()


def run(spark: SparkSession, source: str, folder: str, checkpoint: str, least: float = 0.3, available_now: bool = True) -> StreamingQuery:
    """Starts the query over a folder of JSON lines."""
    stream = spark.readStream.schema(SCHEMA).json(source)
    writer = stream.writeStream.foreachBatch(lambda df, n: accept(df, n, folder, least)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
