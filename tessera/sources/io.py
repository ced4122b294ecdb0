"""Readers and writers. Order is a column: every reader that needs it attaches ``ordinal``, the line number from 0."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tessera.functions import text as T

MESSAGE = "array<struct<role:string,content:string>>"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: S.StructType | str) -> DataFrame:
    """One object per line (O01); a field that a line lacks is null."""
    return spark.read.schema(schema).json(path)


def read_json_array(spark: SparkSession, path: str, schema: S.StructType | str) -> DataFrame:
    """A file that is one array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def with_ordinal(df: DataFrame) -> DataFrame:
    """Adds the position of each row of a scan in its order: rows are numbered within their partition, and the counts of the partitions before
    are added, so files stay split and rows stay where they are, in the JVM. The list of partitions, a row of two numbers each, is ordered in one task
    and broadcast: some ten MB at a million partitions."""
    low = (1 << 33) - 1  # monotonically_increasing_id holds the row's number within its partition there
    placed = df.withColumn("_in", F.monotonically_increasing_id())
    part = F.shiftright("_in", 33)
    counts = placed.groupBy(part.alias("_of")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_of").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    joined = placed.withColumn("_part", part).join(F.broadcast(counts.select("_of", before.alias("_before"))), F.col("_part") == F.col("_of"))
    return joined.select(*df.columns, (F.col("_before") + F.col("_in").bitwiseAND(F.lit(low))).alias("ordinal"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, value): the lines of one text file."""
    return with_ordinal(spark.read.text(path)).select("ordinal", "value")


def read_text(spark: SparkSession, path: str) -> str:
    """A whole prompt file; it is a driver's parameter, not data."""
    return spark.read.text(path, wholetext=True).first()[0]


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Lines with literal \\n unescaped."""
    return read_lines(spark, path).withColumn("value", T.unescape_newlines(F.col("value")))


def none_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit("None"))


def read_scalar_sidecar(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """(ordinal, value) of a file with one value or None per line."""
    return read_lines(spark, path).select("ordinal", none_to_null(F.col("value")).try_cast(kind).alias("value"))


def read_tag_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, tags) of a file with one JSON array per line."""
    return read_lines(spark, path).select("ordinal", F.from_json("value", "array<struct<tag:string,explanation:string>>").alias("tags"))


def attach(df: DataFrame, sidecar: DataFrame, column: str, value: str = "value") -> DataFrame:
    """Sets ``column`` from a sidecar by ordinal where it has the line, and keeps the row's own value elsewhere."""
    side = sidecar.select(F.col("ordinal").alias("_o"), F.col(value).alias("_v"), F.lit(True).alias("_there"))
    joined = df.join(side, df.ordinal == F.col("_o"), "left")
    own = F.col(column) if column in df.columns else F.lit(None)
    return joined.withColumn(column, F.when(F.col("_there"), F.col("_v")).otherwise(own)).drop("_o", "_v", "_there")


def first_n(df: DataFrame, n: int, key: str = "ordinal") -> DataFrame:
    """The first n rows by key, train[:n]."""
    return df.orderBy(key).limit(n)


def index_slice(df: DataFrame, start: int | None, end: int | None, key: str = "ordinal") -> DataFrame:
    """Rows [start:end] by an ordinal key."""
    out = df if start is None else df.where(F.col(key) >= start)
    return out if end is None else out.where(F.col(key) < end)


def read_csvs(spark: SparkSession, folder: str, pattern: str = "*.csv", schema: str | None = None) -> DataFrame:
    """All CSV files with a header below a folder whose names match (O08), with the file's name."""
    reader = spark.read.option("header", True).option("pathGlobFilter", pattern).option("multiLine", True).option("escape", '"')
    rows = reader.schema(schema).csv(folder) if schema else reader.csv(folder)
    return rows.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def load_training(spark: SparkSession, path: str, kind: str = "sft") -> DataFrame:
    """messages, or prompt and completion, from a .json, .jsonl or .parquet file."""
    wanted = ["messages"] if kind == "sft" else ["prompt", "completion"]
    suffix = PurePosixPath(path.rstrip("/")).suffix
    if suffix in (".jsonl", ".json"):
        df = spark.read.option("multiLine", suffix == ".json").json(path)
    elif suffix == ".parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"{path}: expected .json, .jsonl or .parquet")
    if missing := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    return df.select(*wanted, *(["label"] if kind == "kto" and "label" in df.columns else []))


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    """O11; null fields are left out of a line, as the readers expect."""
    df.write.mode(mode).json(path)


def write_splits(df: DataFrame, folder: str, split: str = "split", mode: str = "overwrite") -> None:
    """One folder of lines per split (O12, O16): <folder>/split=train and so on."""
    df.write.mode(mode).partitionBy(split).json(folder)


def write_pretty(df: DataFrame, path: str, mode: str = "overwrite", indent: int = 4) -> None:
    """One indented JSON array in order of ``ordinal`` (O12); for a file that is read as a whole, so it is written by one task."""

    def lines(batches):
        line = "["  # it waits, as a comma follows all rows but the last
        for rows in batches:
            for told in rows["told"]:
                yield pd.DataFrame({"value": [line if line == "[" else line + ","]})
                text = json.dumps(json.loads(told), indent=indent, ensure_ascii=False)
                line = " " * indent + text.replace("\n", "\n" + " " * indent)
        yield pd.DataFrame({"value": [line, "]"]})

    rows = df.select(F.to_json(F.struct(*(c for c in df.columns if c != "ordinal"))).alias("told"), "ordinal")
    text = rows.coalesce(1).sortWithinPartitions("ordinal").mapInPandas(lines, "value string")
    text = df.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1) if df.isEmpty() else text
    text.write.mode(mode).text(path)


def write_scalar_sidecar(df: DataFrame, path: str, column: str = "value", mode: str = "overwrite") -> None:
    """One value per line in order, null as None (O13). Files follow each other in order of their names."""
    rows = df.repartitionByRange("ordinal").sortWithinPartitions("ordinal")
    rows.select(F.coalesce(F.col(column).cast("string"), F.lit("None")).alias("value")).write.mode(mode).text(path)


def write_tag_sidecar(df: DataFrame, path: str, column: str = "tags", mode: str = "overwrite") -> None:
    rows = df.repartitionByRange("ordinal").sortWithinPartitions("ordinal")
    rows.select(F.coalesce(F.to_json(column), F.lit("[]")).alias("value")).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)  # O14


def annotate(df: DataFrame, answers: DataFrame, input_col: str = "input") -> DataFrame:
    """Human judgements joined by ordinal: input_relevance is n/a where there is no input (O15). ``answers`` has (ordinal, input_relevance, output_correctness)."""
    joined = df.join(answers, "ordinal", "left")
    return joined.withColumn("input_relevance", F.when(F.col(input_col) == "", "n/a").otherwise(F.col("input_relevance")))


def read_language_split(spark: SparkSession, folder: str, lang: str, split: str, schema: str) -> DataFrame:
    """One split of one language of a folder laid out as lang=.../split=... (O16); partitions are pruned."""
    return spark.read.schema(schema + ", lang string, split string").json(folder).where((F.col("lang") == lang) & (F.col("split") == split)).drop("lang", "split")


def done_keys(spark: SparkSession, path: str, key: str, kind: str = "string") -> DataFrame:
    """The keys already written at ``path``; none if there is no output yet."""
    shape = f"{key} {kind}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(shape).json(path).distinct() if there else spark.createDataFrame([], shape)


def next_index(spark: SparkSession, path: str, key: str = "request_idx") -> int:
    """One more than the highest index written, 0 at first."""
    top = done_keys(spark, path, key, "long").agg(F.max(key)).first()[0]
    return 0 if top is None else top + 1
