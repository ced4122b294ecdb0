"""The trained embedder against numpy's singular value decomposition, and in the mixture pipeline."""

import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import embedder
from tessera.plans import pipelines
from tessera.sources.config import Mixture

WORDS = "river stone bread metal cloud engine paper garden window signal".split()


def texts(n, seed=1):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS[5 * (i % 2) : 5 * (i % 2) + 5], rng.integers(3, 9))) for i in range(n)]


def test_axes_are_those_of_the_svd(spark):
    size, told = 1 << 9, [*texts(60), None, "", "  "]
    df = spark.createDataFrame([(t,) for t in told], "text string").repartition(4)
    model = embedder.fit_embedder(df, "text", rank=5, size=size, power=6)
    slots, n, at = embedder.features(told, size)
    full = np.zeros((len(told), size))
    seen = np.bincount(slots, minlength=size)
    idf = np.where(seen > 0, np.log((1 + len(told)) / (1 + seen)) + 1, 0)
    for i in range(len(told)):
        full[i, slots[at[i] : at[i + 1]]] = (1 + np.log(n[at[i] : at[i + 1]])) * idf[slots[at[i] : at[i + 1]]]
    full /= np.maximum(np.linalg.norm(full, axis=1, keepdims=True), 1e-300)
    _, s, v = np.linalg.svd(full, full_matrices=False)
    assert model.idf == pytest.approx(idf, rel=1e-5)
    assert model.strength == pytest.approx(s[:5], rel=1e-4)
    assert np.abs((model.axes * v[:5].T).sum(axis=0)) == pytest.approx(np.ones(5), abs=1e-3)  # up to sign
    got = model.vectors(told)
    want = full @ v[:5].T
    assert np.abs(got[:60]) == pytest.approx(np.abs(want[:60] / np.linalg.norm(want[:60], axis=1, keepdims=True)), abs=2e-2)
    assert not got[60:].any()


def test_like_texts_are_near(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts(80))], "id long, text string")
    model = embedder.fit_embedder(df, "text", rank=4, size=1 << 10)
    x = np.array([r.embedding for r in model.embed(df, "text").orderBy("id").collect()])
    assert np.linalg.norm(x, axis=1) == pytest.approx(np.ones(80), abs=1e-5)
    near = x @ x.T
    same = np.arange(80)[:, None] % 2 == np.arange(80) % 2
    assert near[same].mean() > near[~same].mean() + 0.5
    nothing = embedder.fit_embedder(df.limit(0), "text", rank=4, size=1 << 10)
    assert not nothing.vectors(["river"]).any()


def test_mixture_with_a_trained_embedder(spark):
    say = "data_id long, messages array<struct<role:string,content:string>>, origin string, language string, reward double, quality double, complexity double, setfit_label string"
    rows = lambda first, told: spark.createDataFrame([(first + i, [("user", t)], "o", "en", 1.0 + i, 1.0, 1.0, "a") for i, t in enumerate(told)], say)
    parts = {"one": rows(0, texts(8)), "two": rows(100, [*texts(4), "something else entirely", "zebra quartz"])}
    model = embedder.fit_embedder(parts["one"].selectExpr("messages[0].content as text").unionByName(parts["two"].selectExpr("messages[0].content as text")), "text", rank=12, size=1 << 10)
    mix = Mixture("m", parts=[{"name": "one"}, {"name": "two", "min_distance": 0.05}], proportions={})
    out = pipelines.build_mixture(mix, lambda p: parts[p["name"]], lambda df: model.embed(df, "text"), share=0.5).collect()
    kept = {r.data_id for r in out}
    assert set(range(8)) <= kept and {104, 105} <= kept and not kept & {100, 101, 102, 103}  # copies of the first part go


def test_features_are_kept_small(spark, monkeypatch):
    """The table that the passes read takes under two bytes for each feature of a text."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10), p=np.arange(26, 0, -1) / 351)) for _ in range(400)]
    told = [" ".join(rng.choice(words, 300)) for _ in range(150)]
    sizes = []

    class Seen(embedder.Tables):
        def put(self, df, *by, **more):
            out = super().put(df, *by, **more)
            path = out._tables_path.removeprefix("file:")
            sizes.append(sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.startswith("part-")))
            return out

    monkeypatch.setattr(embedder, "Tables", Seen)
    embedder.fit_embedder(spark.createDataFrame([(t,) for t in told], "text string").coalesce(1), "text", rank=4, power=1)
    assert len(sizes) == 1 and 0 < sizes[0] < 2 * len(embedder.features(told)[0])


def test_numbers_are_packed_and_unpacked():
    for numbers in ([], [0], [1, 255, 256, 65536, 2**32 - 1]):
        assert embedder.unpacked(embedder.packed(np.array(numbers, np.int64))).tolist() == numbers


def test_embedded_from_the_counted_features(spark):
    """The table that comes with the model holds its vectors, and no text is read twice."""
    told = [*texts(90), None, "", "  ", "river " * 3000]
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def read(text: pd.Series) -> pd.Series:
        seen.add(len(text))
        return text

    df = spark.createDataFrame([(f"t{i}", t) for i, t in enumerate(told)], "name string, text string").repartition(3)
    model, table = embedder.fit_and_embed(df.withColumn("text", read("text")), "name", "text", rank=6, size=1 << 9)
    assert seen.value == len(told)
    got = {r.name: r.vector for r in table.collect()}
    want = model.vectors(told)
    assert len(got) == len(told)
    assert np.array([got[f"t{i}"] for i in range(len(told))]) == pytest.approx(want, abs=1e-4)
    assert not want[90:93].any() and want[93].any()
    plain = embedder.fit_embedder(df, "text", rank=6, size=1 << 9)
    assert model.strength == pytest.approx(plain.strength, rel=1e-5)


def test_small_numbers_take_few_bytes():
    assert len(embedder.packed(np.array([1, 2, 255]))) == 1 + 3
    rows = [[1, 2], [], [70000, 3], [300], []]
    column = pa.array([embedder.packed(np.array(r, np.int64)) for r in rows], pa.binary())
    numbers, at = embedder.unpacked_rows(column.slice(1))
    assert numbers.tolist() == [70000, 3, 300] and at.tolist() == [0, 0, 2, 3, 3]


def test_texts_are_counted_in_bounded_stretches():
    told = ["a" * 70_000, "b", "c" * 70_000, None, *["d"] * 130]
    parts = [told[s] for s in embedder.stretches(told)]
    assert sum(parts, []) == told and [len(p) for p in parts] == [3, 64, 64, 3]
    assert not list(embedder.stretches([]))
