"""The growing collection of vectors: appends touch few cells, and searches equal those of one table."""

import os

import numpy as np
import pytest

from tessera.operators import neighbours
from tessera.operators.collection import VectorCollection

SHAPE = "k long, document string, vector array<double>"


def rows(n, seed, first=0, groups=8):
    rng = np.random.default_rng(seed)
    heads = np.random.default_rng(99).standard_normal((groups, 12))
    x = heads[rng.integers(0, groups, n)] + 0.05 * rng.standard_normal((n, 12))
    return [(first + i, f"d{first + i}", v.tolist()) for i, v in enumerate(x)]


def written(folder, number):
    path = os.path.join(folder, "rows", f"batch={number}")
    return {d for d in os.listdir(path) if d.startswith("cell=")} if os.path.isdir(path) else set()


def test_three_appends_are_one_load(spark, tmp_path):
    parts = [rows(120, 1), rows(90, 2, 120), rows(60, 3, 210)]
    grown, whole = VectorCollection(spark, str(tmp_path / "a"), most=40, files=3), VectorCollection(spark, str(tmp_path / "b"), most=40)
    for part in parts:
        grown.append(spark.createDataFrame(part, SHAPE).repartition(3), "k")
    every = [r for part in parts for r in part]
    whole.append(spark.createDataFrame(every, SHAPE), "k")
    for c in (grown, whole):
        assert sorted((r.id, r.document) for r in c.rows().collect()) == [(k, d) for k, d, _ in every]
        assert max(x.rows for x in c.cells()[0].values()) <= 40 and c.cells()[1] == len(every)
    q = spark.createDataFrame([(i, v) for i, _, v in rows(25, 7)], "id long, vector array<double>")
    plain = spark.createDataFrame([(k, v) for k, _, v in every], "id long, vector array<double>")
    told = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.distance, 9)) for r in df.collect())
    assert told(grown.nearest(q, 4)) == told(whole.nearest(q, 4)) == told(neighbours.nearest(q, plain, 4))
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(grown.near_ids(q, 0.002)) == ids(neighbours.near_ids(q, plain, 0.002))


def test_an_append_writes_only_cells_it_touches(spark, tmp_path):
    c = VectorCollection(spark, str(tmp_path / "c"), most=60, files=10)
    c.append(spark.createDataFrame(rows(300, 1), SHAPE), "k")
    before, _ = c.cells()
    one = [(0, "x", rows(1, 5)[0][2])]
    number = c.append(spark.createDataFrame(one, SHAPE), "k")
    assert len(written(c.folder, number)) == 1 < len(before)
    after, total = c.cells()
    assert total == 301 and sum(before[k] != after.get(k) for k in before) == 1
    assert c.rows().where("id = 300").first().document == "x"
    again = c.append(spark.createDataFrame([(0, "y", one[0][2])], SHAPE), "k", number)  # a batch replaces its own rows
    assert again == number and [r.document for r in c.rows().where("id >= 300").collect()] == ["y"]


def test_equal_vectors_and_nothing(spark, tmp_path):
    c = VectorCollection(spark, str(tmp_path / "d"), most=10)
    q = spark.createDataFrame([(0, [1.0, 0.0])], "id long, vector array<double>")
    assert c.nearest(q, 1).count() == 0 and c.near_ids(q, 0.5).count() == 0
    c.append(spark.createDataFrame([], SHAPE), "k")
    same = [(i, "s", [1.0, 0.0]) for i in range(35)] + [(40, "null", None), (41, "zero", [0.0, 0.0])]
    c.append(spark.createDataFrame(same, SHAPE), "k")
    cells, total = c.cells()
    assert total == 37 and len(cells) >= 4 and sum(x.rows for x in cells.values()) == 35
    assert [r.id for r in c.nearest(q, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert c.near_ids(q, 0.1).count() == 1


def test_a_search_reads_cells_in_reach_only(spark, tmp_path):
    c = VectorCollection(spark, str(tmp_path / "e"), most=40)
    c.append(spark.createDataFrame(rows(300, 1, groups=8), SHAPE), "k")
    asked = []
    read = c._read
    c._read = lambda cells, wanted: asked.extend(wanted) or read(cells, wanted)
    one = spark.createDataFrame([(0, rows(1, 5)[0][2])], "id long, vector array<double>")
    assert c.nearest(one, 1).first().distance == pytest.approx(0, abs=0.05)
    assert 1 <= len(set(asked)) < len(c.cells()[0])
