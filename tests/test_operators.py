"""Ranks, samples, statistics, neighbours and selection against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import collection, judge, neighbours, ranking, stats, translate


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def numbers(spark, n):
    return spark.range(n).withColumn("g", F.concat(F.lit("g"), (F.col("id") % 3).cast("string")))


def test_shuffle_samples_and_splits(spark):
    df = numbers(spark, 500)
    order = sorted(range(500), key=lambda i: hashlib.md5(f"{i}s".encode()).hexdigest())
    got = {r["rank"]: r.id for r in ranking.shuffled(df, "id", "s").collect()}
    assert [got[k + 1] for k in range(500)] == order
    assert ids(ranking.sample_k(df, "id", 7, "s")) == sorted(order[:7])
    assert ids(ranking.sample_share(df, "id", 0.1, "s")) == sorted(order[:50])
    split = {r.id: r.split for r in ranking.train_val(df, "id", 0.985, "s").collect()}
    assert sorted(i for i, s in split.items() if s == "train") == sorted(order[: int(0.985 * 500)])
    assert {r.split for r in ranking.train_val(df, "id", 0).collect()} == {"val"} and {r.split for r in ranking.train_val(df, "id", 1).collect()} == {"train"}
    assert ranking.stratified(df, "g", "id", 30).groupBy("g").count().orderBy("g").collect()[0]["count"] == int(30 * 167 / 500)
    assert ranking.bootstrap(df.where("id < 9"), df, "id", 10, "b").count() == 9
    assert ids(ranking.ordinal(df.where("id % 2 = 1"), "id", width=7), "ordinal") == list(range(250))


def test_line_window_and_pick(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (2, ""), (3, "x\n"), (4, None)], "id long, t string")
    for seed in range(6):
        for r in df.select("id", "t", ranking.line_window(F.col("t"), F.col("id"), seed=seed).alias("w")).collect():
            if r.t:
                assert r.w and r.w in r.t
    got = {r[0] for r in numbers(spark, 50).select(ranking.pick(["a", "b"], F.col("id"))).collect()}
    assert got == {"a", "b"}


def slow_plan(counts, shares):
    n = sum(counts.values())
    plan = dict(shares)
    free = [k for k, p in shares.items() if p < 0]
    rest = 1 - sum(p for p in shares.values() if p > 0)
    own = sum(counts.get(k, 0) / n for k in free)
    for k in free:
        plan[k] = counts.get(k, 0) / n / own * rest if own else 0
    most = int(min(counts.get(k, 0) / p for k, p in plan.items() if p > 0))
    return {k: int(most * p) for k, p in plan.items()}


def test_proportions():
    rng = random.Random(0)
    for _ in range(200):
        counts = {k: rng.randrange(0, 50) for k in "abcd"} | {"z": 9}
        shares = {"a": 0.4, "b": rng.choice([0.2, 0.0, -1]), "c": rng.choice([-1, 0.1]), "d": 0.0}
        assert ranking.proportion_plan(counts, shares) == slow_plan(counts, shares)
    assert ranking.proportion_plan({"a": 3}, {"a": 0.0}) == {"a": 0}


def test_quota_and_top(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], float(i % 5) if i % 7 else None) for i in range(40)], "id long, label string, p double")
    got = ranking.category_quota(df, "label", "p", "id", {"a": 0.25}, 10)
    assert got.where("label = 'a'").count() == 3 and got.where("label = 'b'").count() == 20
    assert [r.id for r in ranking.top(df, "p", "id", 3).collect()] == [4, 9, 19]
    assert None not in {r.p for r in ranking.top(df, "p", "id", 30).collect()}


def test_first_by_key_keeps_nulls(spark):
    df = spark.createDataFrame([(3, None), (1, None), (2, "x"), (0, "x")], "id long, k string")
    assert sorted((r.id, r.k or "") for r in stats.first_by_key(df, [F.col("k")], F.col("id")).collect()) == [(0, "x"), (1, "")]


def test_histogram_bins_as_numpy(spark):
    rng = np.random.default_rng(0)
    for values in (rng.normal(size=700), rng.integers(0, 3, 200).astype(float), np.ones(5), rng.exponential(size=33)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        want = np.histogram(values, bins="auto")[0]
        got = np.zeros(len(want), int)
        for r in stats.histogram(df, "v").collect():
            got[r.bin] += r.n
        assert got.sum() == len(values)
        if len(set(values)) > 1:
            edges = len(want)
            assert stats.auto_bins(len(values), values.min(), values.max(), *np.subtract(*np.percentile(values, [75, 25])).reshape(1)) == edges
    assert stats.histogram(spark.createDataFrame([], "v double"), "v").collect() == []


def test_tags_counters_and_ols(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), (["a"],), ([],)], "t array<string>")
    assert {r.tag: r.n for r in stats.tag_counts(df, "t").collect()} == {"a": 3, "b": 1}
    (d,) = stats.tag_diversity(df, "t").collect()
    assert d.unique_per_row == pytest.approx(2 / 3) and d.inverse_frequency == pytest.approx(3 * 2 / (100 * 4))
    line = spark.createDataFrame([(x, 2.0 * x + 1) for x in range(5)], "x int, y double")
    (o,) = stats.ols(line, "x", "y").collect()
    assert (o.slope, o.intercept) == (pytest.approx(2), pytest.approx(1))
    assert stats.spearman(spark.createDataFrame([(1, 1), (2, 4), (2, 9), (3, 16), (None, 2)], "x int, y int"), "x", "y").first().r == pytest.approx(0.9486832980505138)


def vectors(n, d=6, seed=0, groups=8):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((groups, d))
    return [(i, (base[i % groups] + 0.4 * rng.standard_normal(d)).tolist()) for i in range(n)]


@pytest.mark.parametrize("block", [7, 4096])
def test_nearest(spark, block):
    rows = vectors(90)
    df = spark.createDataFrame([*rows, (500, None), (501, [0.0] * 6)], "id long, vector array<double>")
    got = neighbours.nearest(df.where("id < 20 or id >= 500"), df, 3, block=block, skip_same_id=True)
    x = np.array([v for _, v in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(20):
        d = 1 - u @ u[q]
        d[q] = 9
        want = np.lexsort((np.arange(90), d))[:3]
        own = sorted((r["rank"], r.id, r.distance) for r in got.where(F.col("query_id") == q).collect()) if q < 3 else None
        if own:
            assert [i for _, i, _ in own] == want.tolist() and [z for _, _, z in own] == pytest.approx(d[want].tolist())
    assert got.select("query_id").distinct().count() == 20


def test_self_distance(spark):
    rows = [(0, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a "), (2, [0.0, 1.0], "b"), (3, [0.6, 0.8], "c")]
    got = {r.id: r.distance for r in neighbours.self_distance(spark.createDataFrame(rows, "id long, vector array<double>, text string")).collect()}
    assert got[0] == pytest.approx(0) and got[1] == pytest.approx(0) and got[2] == pytest.approx(0.2) and got[3] == pytest.approx(0.2)


def accepted(rows, *args, **more):
    state = neighbours.Greedy(*args, **more)
    return [k for k, r in enumerate(rows) if state.take(*r)]


def test_greedy_select_is_the_sequential_pass(spark):
    rows = [(i, (i * 37) % 101, v) for i, v in vectors(100, seed=3)]
    df = spark.createDataFrame(rows, "id long, rank long, vector array<double>")
    ordered = sorted(rows, key=lambda r: r[1])
    for least in (0.05, 0.3):
        kept = sorted(ordered[k][0] for k in accepted([(v,) for _, _, v in ordered], least))
        assert ids(neighbours.greedy_select(df, least)) == kept
        assert ids(neighbours.greedy_pass(df.repartition(5), least)) == kept


def test_greedy_pass_with_quotas_and_tags(spark):
    rows = [([1, 0], "a", ["x"]), ([1, 0.01], "a", ["x"]), ([1, 0.01], "b", ["y"]), ([0, 1], "a", []), ([0, -1], "a", []), ([-1, 0], "b", [])]
    assert accepted(rows, 0.3, quotas={"a": 2}, tags=True) == [0, 2, 3, 5]
    assert accepted(rows, 0.3, size=2) == [0, 3]
    assert accepted(rows, 0.3, base=np.array([[1.0, 0.0]])) == [3, 4, 5]
    assert accepted(rows, 0.3, tags=True, seen={"x", "y"}) == [0, 3, 4, 5]
    assert accepted(rows, 0) == [0, 1, 2, 3, 4, 5]
    df = spark.createDataFrame([(i, i, [float(c) for c in v], label, tags, i == 3) for i, (v, label, tags) in enumerate(rows)], "id long, rank long, vector array<double>, label string, tags array<string>, near boolean")
    assert ids(neighbours.greedy_pass(df.repartition(3), 0.3, quotas={"a": 2}, tags=True)) == [0, 2, 4, 5]


def test_collection_and_pairs(spark):
    base = collection.numbered(numbers(spark, 3), "id").select("id", "g")
    more = collection.append(base, numbers(spark, 2).withColumn("o", F.col("id") + 10).drop("id"), "o")
    assert sorted(r.id for r in more.collect()) == ["0", "1", "2", "3", "4"]
    assert [r[0] for r in numbers(spark, 5).select(collection.batch_of(F.col("id"), 2)).collect()] == [0, 0, 1, 1, 2]
    say = "array<struct<role:string,content:string>>"
    rows = [(k, f"s_x_en_{k}", [("user", f"q{k // 2}")], [("assistant", f"c{k}")]) for k in range(4)]
    df = spark.createDataFrame(rows, f"ordinal long, data_id string, prompt {say}, completion {say}")
    packed = translate.pack_pairs(df.repartition(3))
    back = sorted((r.data_id, r.label, r.completion[0].content) for r in translate.unpack_pairs(packed).collect())
    assert back == [(f"s_x_en_{k}", k % 2 == 0, f"c{k}") for k in range(4)]
    assert packed.count() == 2


def test_judging(spark):
    text = "data_id string, text string"
    source = spark.createDataFrame([("a_b_en_1", "s1"), ("a_b_en_2", "s2")], text)
    one = spark.createDataFrame([("a_b_de_1", "t1"), ("a_b_de_3", "t3")], text)
    two = spark.createDataFrame([("a_b_de_1", "u1"), ("a_b_de_2", "u2")], text)
    assert [tuple(r) for r in judge.judged_rows(source, one, two, "de").collect()] == [("a_b_de_1", "s1", "t1", "u1")]
    rows = spark.createDataFrame([("Translation (a", "m", "n"), ("n", "n", "m"), (None, "m", "n"), ("Translation (b)", "n", "m")], "winner string, model1 string, model2 string")
    got = {(r.pair, r.winner): (r.n, r.share) for r in judge.win_rates(rows).collect()}
    assert got == {("m vs n", "m"): (2, pytest.approx(2 / 3)), ("m vs n", "n"): (1, pytest.approx(1 / 3))}


def test_greedy_select_of_long_chains(spark):
    """A chain in order of rank is decided in one row a round; the rest goes to one task, whatever its length."""
    rows = [(i, i, [math.cos(0.1 * i), math.sin(0.1 * i)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, rank long, vector array<double>")
    near = spark.createDataFrame([p for i in range(300 - 1) for p in ((i, i + 1), (i + 1, i))], "a long, b long")
    chain = spark.createDataFrame([(i, i, [1.0]) for i in range(300)], "id long, rank long, vector array<double>")
    assert sorted(r.id for r in neighbours.greedy_select(chain, 0.1, near).collect()) == list(range(0, 300, 2))
    one = sorted(r.id for r in neighbours.greedy_select(df, 0.004, small=0).collect())
    assert one == sorted(r.id for r in neighbours.greedy_select(df, 0.004).collect()) == sorted(r.id for r in neighbours.greedy_pass(df, 0.004).collect())


def test_quantiles_are_exact(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    for values in ([3.0], [1.0, 1.0, 2.0], rng.integers(0, 40, 500).astype(float).tolist(), rng.standard_normal(700).tolist()):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
        shares = [0, 0.25, 0.5, 0.95, 1]
        for few, near in ((100_000, 2e-4), (10, 0.05)):
            got = stats.quantiles(df.withColumn("y", -F.col("x")), {"x": shares, "y": shares[1:]}, few, near)
            assert got["x"] == pytest.approx(np.quantile(values, shares).tolist(), rel=1e-12)
            assert got["y"] == pytest.approx(np.quantile(-np.array(values), shares[1:]).tolist(), rel=1e-12)
    assert stats.p95(spark.createDataFrame([], "x double"), ["x"]) == {"x": None}


def test_quantiles_take_three_scans(spark):
    """However many columns, shares and brackets."""
    scans = spark.sparkContext.accumulator(0)

    def count(batches):
        scans.add(1)
        yield from batches

    df = spark.range(0, 5000, 1, 1).select(*(((F.col("id") * (k + 3)) % 997).cast("double").alias(f"c{k}") for k in range(6)))
    got = stats.quantiles(df.mapInArrow(count, df.schema), {f"c{k}": [0.1, 0.5, 0.95] for k in range(6)}, few=10, near=0.01)
    assert scans.value <= 3
    for k in range(6):
        assert got[f"c{k}"] == pytest.approx(np.quantile((np.arange(5000) * (k + 3)) % 997, [0.1, 0.5, 0.95]).tolist())


@pytest.mark.parametrize("parts", [1, 7])
def test_global_rank_with_a_hot_key(spark, parts):
    """A third of the rows have one key; they are dealt over ranges by the rest of the order."""
    rows = [(5 if i % 3 == 0 else i % 11, i) for i in range(900)]
    df = spark.createDataFrame(rows, "k int, id long").repartition(parts)
    ranked = ranking.global_rank(df, [F.desc("k"), F.asc("id")], "r", width=50)
    assert [(r.k, r.id) for r in sorted(ranked.collect(), key=lambda r: r.r)] == sorted(rows, key=lambda x: (-x[0], x[1]))
    assert sorted(r.r for r in ranked.collect()) == list(range(1, 901))
    spread = df.repartitionByRange(18, F.desc("k"), F.asc("id")).groupBy(F.spark_partition_id()).count()
    assert spread.agg(F.max("count")).first()[0] < 120


def test_ordinals_of_sparse_keys(spark):
    keys = [7, 10**15, 3, -5, 10**9, 10**9 + 1, 42]
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(3)
    assert {r.k: r.ordinal for r in ranking.ordinal(df, "k").collect()} == {k: i for i, k in enumerate(sorted(keys))}


def test_neighbours_in_ties(spark):
    """Very many rows at one distance go by id."""
    q = spark.createDataFrame([(0, [1.0, 0.0])], "id long, vector array<double>")
    c = spark.createDataFrame([(i, [1.0, 1.0 if i % 2 else -1.0]) for i in range(500, 0, -1)], "id long, vector array<double>").repartition(5)
    assert [r.id for r in neighbours.nearest(q, c, 20, block=64).orderBy("rank").collect()] == list(range(1, 21))


def test_task_registry():
    known = translate.task_registry()
    assert len(known) == 64 and known["hendrycks_virology"][1] == "virology" and known["arc_easy"] == (translate.TASKS["arc"], "ARC-Easy")


def test_winogrande(spark):
    task = translate.TASKS["winogrande"]
    df = task.packed(spark.createDataFrame([("The _ fell.",)], "sentence string"))
    assert df.first().combined == "The <x>_</x> fell."
    back = task.unpacked(df.withColumn("translated", F.col("combined")))
    assert back.first().sentence == "The _ fell."


def test_samples_of_each_request(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "id long, text string").repartition(4)
    asks = spark.range(3, 6).withColumnRenamed("id", "ask")
    got = {}
    for r in ranking.sample_each(df, asks, "ask", "id", 7, "s").collect():
        got.setdefault(r.ask, set()).add(r.id)
    assert got == {r: {x.id for x in ranking.sample_k(df, "id", 7, f"s-{r}").collect()} for r in (3, 4, 5)}
