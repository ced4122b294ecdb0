"""Tag statistics of many datasets that are kept beside them and merged."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import tables as T

#: Registers of a sketch of distinct tags, as a power of two: its relative standard error is about 1.04 / 2^(LOG_K / 2), 1.6 %.
LOG_K = 12


class DiversityStore:
    """For each dataset its tag counts and one row of sums with a sketch of its distinct tags. Adding a dataset reads only that dataset; a report merges the
    rows and sketches, and reads counts of single tags only for those it names. Adding one again replaces it."""

    ROW = "dataset string, size long, occurrences long, tags long, sketch binary, means map<string,double>, part string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def add(self, dataset: str, rows: DataFrame, tags: str = "tags", metrics: tuple[str, ...] = ()) -> None:
        """Counts the tags of ``rows`` once; null tags and null lists count for nothing. The means of ``metrics`` are kept too, nulls left out."""
        part = uuid.uuid4().hex
        tables = T.Tables(self.spark)
        one = tables.put(rows.select(F.col(tags).alias("tags"), *(F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(metrics))))
        counts = one.select(F.explode("tags").alias("tag")).where("tag is not null").groupBy("tag").agg(F.count("*").alias("n"))
        counts.sortWithinPartitions("tag").write.parquet(f"{self.folder}/counts/part={part}")
        counts = self.spark.read.schema("tag string, n long").parquet(f"{self.folder}/counts/part={part}")
        means = F.create_map(*(x for i, m in enumerate(metrics) for x in (F.lit(m), F.avg(f"m{i}")))) if metrics else F.create_map().cast("map<string,double>")
        sums = one.agg(F.count("*").alias("size"), means.alias("means"))
        told = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"), F.count("*").alias("tags"), F.hll_sketch_agg("tag", LOG_K).alias("sketch"))
        both = sums.unionByName(told, allowMissingColumns=True)  # a row each
        row = both.agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("size", "occurrences", "tags", "sketch", "means")))
        row = row.select(F.lit(dataset).alias("dataset"), "size", "occurrences", "tags", "sketch", "means", F.lit(part).alias("part"))
        name = f"{self.folder}/rows/dataset-{uuid.uuid5(uuid.NAMESPACE_OID, dataset).hex}"
        draft = f"{self.folder}/drafts/{part}"
        row.coalesce(1).write.parquet(draft)
        T.remove(self.spark, name)
        T.make(self.spark, f"{self.folder}/rows")
        T.rename(self.spark, draft, name)
        tables.clear()

    def rows(self) -> DataFrame:
        names = T.children(self.spark, f"{self.folder}/rows")
        if not names:
            return self.spark.createDataFrame([], self.ROW)
        return self.spark.read.schema(self.ROW).parquet(*(f"{self.folder}/rows/{n}" for n in names))

    def report(self) -> DataFrame:
        """Per dataset: size, occurrences, its exact number of different tags, tags per row, rows x tags / (100 x occurrences), and the means."""
        d, n, t = F.col("tags"), F.col("size"), F.col("occurrences")
        some = lambda c, by: F.when(by > 0, c / by)
        return self.rows().select("dataset", "size", "occurrences", "tags", some(d, n).alias("tag_diversity"), some(n * d, 100.0 * t).alias("inverse_frequency"), "means")

    def distinct_tags(self, datasets: list[str] | None = None) -> int:
        """How many different tags the datasets have together, by their merged sketches: within about 1.6 % (one standard error)."""
        rows = self.rows() if datasets is None else self.rows().where(F.col("dataset").isin(datasets))
        return rows.where("occurrences > 0").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n")).first()["n"] or 0

    def frequent(self, share: float, datasets: list[str] | None = None) -> DataFrame:
        """(tag, n): all tags with at least ``share`` of all occurrences, counted exactly. Such a tag has that share of some dataset, so the tags that have it there are the only
        candidates, at most 1 / share for each dataset; a second pass adds up only these."""
        rows = self.rows() if datasets is None else self.rows().where(F.col("dataset").isin(datasets))
        told = rows.select("part", "occurrences").collect()  # a row for each dataset
        total = sum(r["occurrences"] for r in told)
        if not total:
            return self.spark.createDataFrame([], "tag string, n long")
        counts = self.spark.read.schema("tag string, n long, part string").option("basePath", f"{self.folder}/counts").parquet(*(f"{self.folder}/counts/part={r['part']}" for r in told))
        least = self.spark.createDataFrame([(r["part"], share * r["occurrences"]) for r in told], "part string, least double")
        candidates = counts.join(F.broadcast(least), "part").where("n >= least").select("tag").distinct()
        return counts.join(candidates, "tag", "left_semi").groupBy("tag").agg(F.sum("n").alias("n")).where(F.col("n") >= share * total)
