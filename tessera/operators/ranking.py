"""Exact ranks, samples and splits that need no global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoints

#: Rows in one range of a global order.
WIDTH = 250_000


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", width: int = WIDTH) -> DataFrame:
    """Adds the rank from 1 over all rows in an order, which must be total for a defined result.

    Rows are dealt by sampled splitters into ranges of about ``width`` rows, as many as there are rows for, and sorted within them; a rank is the
    place in the range, shifted by the counts of the ranges before. Only the list of ranges, a row each, is summed up in one task. Rows of one key share no range
    longer than that as long as the order goes on past the key.
    """
    ensure_checkpoints(df.sparkSession)
    parts = max(1, -(-df.count() // width))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    ranges = rows.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = ranges.select("_range", (before + 1 - F.col("_first")).alias("_shift"))
    ranked = rows.withColumn("_range", F.shiftright("_at", 33)).join(shifts, "_range")
    return ranked.withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def hash_key(key: Column, seed: str | int = "") -> Column:
    """md5 of the key as text followed by the seed: the order of every sample and shuffle here."""
    return F.md5(F.concat(key.cast("string"), F.lit(str(seed))).cast("binary"))


def shuffled(df: DataFrame, key: str, seed: str | int = "", name: str = "rank") -> DataFrame:
    """A permutation in the order of the hash."""
    return global_rank(df, [hash_key(F.col(key), seed), F.col(key)], name)


def ordinal(df: DataFrame, key: str, width: int = WIDTH, name: str = "ordinal") -> DataFrame:
    """Position from 0 in the order of a key."""
    return global_rank(df, [F.col(key)], name, width).withColumn(name, F.col(name) - 1)


def sample_k(df: DataFrame, key: str, k: int, seed: str | int = "") -> DataFrame:
    """k rows without replacement, the first in hash order."""
    return df.orderBy(hash_key(F.col(key), seed), key).limit(k)


def sample_each(df: DataFrame, asks: DataFrame, ask: str, key: str, k: int, seed: str | int = "") -> DataFrame:
    """For each of a few requests (one row each in ``asks``) the k rows that ``sample_k`` gives with the seed "seed-request", with the request.
    One scan: each task keeps its own k first rows of each request before anything is shuffled."""
    numbers = [r[0] for r in asks.select(ask).collect()]  # the requests of one turn
    rows = df.withColumn(ask, F.explode(F.array(*(F.lit(x).cast("long") for x in numbers))))
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"{seed}-"), F.col(ask).cast("string")).cast("binary"))
    return rows.withColumn("_place", F.row_number().over(W.partitionBy(ask).orderBy(order, key))).where(F.col("_place") <= k).drop("_place")


def sample_share(df: DataFrame, key: str, share: float, seed: str | int = "") -> DataFrame:
    """floor(share * n) rows."""
    n = df.count()
    return shuffled(df, key, seed, "_rank").where(F.col("_rank") <= int(share * n)).drop("_rank")


def bootstrap(seeds: DataFrame, machine: DataFrame, key: str, k: int, seed: str | int = "") -> DataFrame:
    """k // 3 seed rows and twice as many machine rows."""
    return sample_k(seeds, key, k // 3, seed).unionByName(sample_k(machine, key, k // 3 * 2, seed), allowMissingColumns=True)


def stratified(df: DataFrame, group: str, key: str, limit: int, seed: str | int = "") -> DataFrame:
    """floor(limit * n_group / n) rows of each group."""
    n = df.count()
    sizes = df.groupBy(group).agg(F.floor(F.lit(limit) * F.count("*") / F.lit(max(n, 1))).alias("_quota")).withColumnRenamed(group, "_group")
    place = F.row_number().over(W.partitionBy(group).orderBy(hash_key(F.col(key), seed), key))
    ranked = df.withColumn("_place", place).where(F.col("_place") <= limit)
    return ranked.join(sizes, F.col(group).eqNullSafe(F.col("_group"))).where(F.col("_place") <= F.col("_quota")).drop("_place", "_quota", "_group")


def train_val(df: DataFrame, key: str, share: float = 0.985, seed: str | int = "", name: str = "split") -> DataFrame:
    """int(share * n) rows are "train", the others "val"; 0 makes all val, 1 all train."""
    n = df.count()
    return shuffled(df, key, seed, "_rank").withColumn(name, F.when(F.col("_rank") <= int(share * n), "train").otherwise("val")).drop("_rank")


def line_window(document: Column, key: Column, least: int = 1, most: int = 15, seed: str | int = "") -> Column:
    """A run of ``least`` to ``most`` lines from a place chosen by the hash of the key."""
    lines = F.split(document, r"(?<=\n)")
    lines = F.filter(lines, lambda x: x != "")
    number = lambda tag: F.conv(F.substring(hash_key(key, f"{seed}{tag}"), 1, 8), 16, 10).cast("long")
    start = F.pmod(number("a"), F.greatest(F.size(lines), F.lit(1)).cast("long")).cast("int")
    size = (F.pmod(number("b"), F.lit(most - least + 1).cast("long")) + least).cast("int")
    return F.array_join(F.slice(lines, start + 1, size), "")


def pick(options: list[str], key: Column, seed: str | int = "") -> Column:
    """One of a few strings by the hash of the key."""
    at = F.pmod(F.conv(F.substring(hash_key(key, seed), 1, 8), 16, 10).cast("long"), F.lit(len(options)).cast("long")).cast("int")
    return F.element_at(F.array(*(F.lit(x) for x in options)), at + 1)


def top(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """The n rows of highest ``by``, nulls last, ties by key."""
    return df.orderBy(F.desc_nulls_last(by), F.asc(key)).limit(n)


def top_per_group(df: DataFrame, group: str, by: list[Column], n: int) -> DataFrame:
    return df.withColumn("_place", F.row_number().over(W.partitionBy(group).orderBy(*by))).where(F.col("_place") <= n).drop("_place")


def category_quota(df: DataFrame, label: str, by: str, key: str, quotas: dict[str, float], size: int) -> DataFrame:
    """In order of preference, at most ceil(quota * size) rows of each label that has a quota; other labels are not bounded."""
    import math

    place = F.row_number().over(W.partitionBy(label).orderBy(F.desc_nulls_last(by), F.asc(key)))
    if not quotas:
        return df
    numbers = {k: math.ceil(q * size) for k, q in quotas.items()}
    most = F.try_element_at(F.create_map(*(F.lit(x) for pair in numbers.items() for x in pair)), F.col(label).cast("string"))
    # the largest number as a literal lets each task drop what it holds beyond it before anything is shuffled
    bounded = df.where(most.isNotNull()).withColumn("_place", place).where(F.col("_place") <= max(0, *numbers.values())).where(F.col("_place") <= most)
    return df.where(most.isNull()).unionByName(bounded.drop("_place"))


def proportion_plan(counts: dict[str, int], shares: dict[str, float]) -> dict[str, int]:
    """How many rows each listed label keeps (O81): as many as fit the positive shares; labels with a negative share
    divide what those leave, by their own counts; a share of 0 keeps none."""
    positive = {k: p for k, p in shares.items() if p > 0}
    free = [k for k, p in shares.items() if p < 0]
    all_rows = sum(counts.values())
    plan = dict(shares)
    if free and all_rows:
        own = {k: counts.get(k, 0) / all_rows for k in free}
        together = sum(own.values())
        rest = 1 - sum(positive.values())
        plan |= {k: (own[k] / together * rest if together else 0.0) for k in free}
    used = {k: p for k, p in plan.items() if p > 0}
    if not used:
        return dict.fromkeys(shares, 0)
    most = int(min(counts.get(k, 0) / p for k, p in used.items()))
    return {k: (int(most * p) if p > 0 else 0) for k, p in plan.items()}


def proportion_fit(df: DataFrame, label: str, by: str, key: str, shares: dict[str, float]) -> DataFrame:
    """The rows of highest preference that fit the shares; labels not listed are dropped."""
    counts = {r[0]: r[1] for r in df.where(F.col(label).isin(list(shares))).groupBy(label).count().collect()}  # one row per listed label
    total = df.count()
    plan = proportion_plan(counts | {"": total - sum(counts.values())}, shares)
    most = F.try_element_at(F.create_map(*(F.lit(x) for k in shares for x in (k, plan[k]))), F.col(label))
    place = F.row_number().over(W.partitionBy(label).orderBy(F.desc_nulls_last(by), F.asc(key)))
    ranked = df.where(F.col(label).isin(list(shares))).withColumn("_place", place).where(F.col("_place") <= max(0, *plan.values()))
    return ranked.where(F.col("_place") <= most).drop("_place")
