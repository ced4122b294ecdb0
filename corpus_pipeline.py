"""From raw documents to packed training sequences, each stage written as Parquet and read again.

quality: documents that the classifier scores under 0.3 go. near_dedup: of documents joined by 5-gram Jaccard
similarities of 0.8 and more the one with the smallest id stays. substrings: words in windows of 50 that also start in a
document with a smaller id go, and documents of which nothing is left. packing: pieces of at most 2048 tokens with
their places in sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._store import Kept, few_files, unused
from tessera.llm.packing import pack
from tessera.llm.quality import fit_quality, score_quality
from tessera.llm.queries import fifth
from tessera.llm.shingle_join import shingle_links
from tessera.llm.substring_dedup import dedup_substrings

THRESHOLD = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score THRESHOLD or more, whole rows. Null and empty texts have the score of a text without words; rows with null or repeated
    ids are scored like any other; without labels every score is 0.5, so all stay; a very long text is read whole; an empty table gives an empty one."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs, labels.where(fifth() != 0))
    score = unused(docs.columns, "_score")
    return score_quality(docs, model, score_col=score).where(F.col(score) >= THRESHOLD).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents but those that links join to a smaller id, whole rows. Texts without words and rows with a null id stay; rows that repeat an id are one
    document and stay or go together; very long texts are compared whole; an empty table gives an empty one."""
    name = unused(docs.columns, "_gone")
    gone = shingle_links(docs).where("not kept").select(F.col("doc_id").alias(name))
    return few_files(docs.join(gone, docs.doc_id == gone[name], "left_anti"))  # rows with a null id stay


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that start in a document with a smaller id; those that lose all go, and n_chars follows the text. A text
    that loses nothing stays as it is, null and empty ones too; rows with a null id lose nothing; rows that repeat an id keep what they share; an
    empty table gives an empty one."""
    at = {name: f"c{i}" for i, name in enumerate(docs.columns)}  # whatever the columns are called
    others = tuple(c for name, c in at.items() if name not in ("doc_id", "text"))
    told = dedup_substrings(docs.toDF(*at.values()), at["doc_id"], at["text"], columns=others, verbatim=True)
    told = told.where("n_removed = 0 or n_removed < n_words")
    size = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(at["n_chars"]))
    new = {"text": F.col("kept_text"), "n_chars": size}
    return told.select(*(new.get(name, F.col(c)).alias(name) for name, c in at.items()))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, as ``pack`` tells: null and empty texts are one piece, rows with null or repeated ids documents of their
    own, an empty table gives an empty one."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), output="crc32").withColumnRenamed("ids", "ids_crc32")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substrings", substrings),
    ("packing", packing),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    kept = Kept(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        done = kept.put(stage(spark, docs, sf_dir), f"pipeline-{name}")
        kept.drop(docs)
        docs = done
    return docs
