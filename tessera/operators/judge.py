"""Pairwise judging of translations: joins by id, verdicts and win rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import stats


def judged_rows(source: DataFrame, one: DataFrame, two: DataFrame, lang: str) -> DataFrame:
    """(data_id, source, translation_1, translation_2) of the ids that both translations hold, the source matched by its id
    with the language rewritten (O49). All have (data_id, text)."""
    keyed = source.select(T.rewrite_language(F.col("data_id"), F.lit(lang)).alias("data_id"), F.col("text").alias("source"))
    a = one.select("data_id", F.col("text").alias("translation_1"))
    b = two.select("data_id", F.col("text").alias("translation_2"))
    return a.join(b, "data_id").join(keyed, "data_id").select("data_id", "source", "translation_1", "translation_2")


def shared_ids(one: DataFrame, two: DataFrame, key: str = "data_id") -> DataFrame:
    return one.select(key).intersect(two.select(key))


def judgements(df: DataFrame, model1: str, model2: str, response: str = "response") -> DataFrame:
    """Winners from raw verdicts (O108), with the names of the pair."""
    a, b = F.lit(model1), F.lit(model2)
    return df.withColumn("winner", T.verdict(F.col(response), a, b)).withColumn("model1", a).withColumn("model2", b)


def win_rates(df: DataFrame) -> DataFrame:
    """Repairs winners, drops null ones, and gives each pair's shares (O109, O110, O71)."""
    fixed = df.withColumn("winner", T.repair_winner(F.col("winner"), F.col("model1"), F.col("model2"))).where("winner is not null")
    return stats.win_rate(fixed.withColumn("pair", T.pair_key(F.col("model1"), F.col("model2"))), "pair", "winner")
