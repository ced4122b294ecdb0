"""Lattice dedup and polytope search against brute force, and their edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.lattice_dedup import e8_decode, e8_shells, lattice_links
from tessera.llm import polytope_search
from tessera.llm.polytope_search import hadamard, search

SCHEMA = "vec_id long, embedding array<float>, label int, id string, cell string, probe int, vector string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", "y", 7, "z") for i, v, l in rows], SCHEMA)


def near(rng, v, angle):
    w = rng.standard_normal(len(v))
    w -= w @ v * v
    w /= np.linalg.norm(w)
    return math.cos(angle) * v + math.sin(angle) * w


def expected_links(rows, threshold=0.98):
    ok = [(k, i, np.array(v, np.float64), l) for k, (i, v, l) in enumerate(rows) if l is not None and i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    n, root = [0] * len(rows), {k: k for k in range(len(rows))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ok)):
        for b in range(a + 1, len(ok)):
            k, _, x, l = ok[a]
            m, _, y, o = ok[b]
            if l == o and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                n[k] += 1
                n[m] += 1
                root[find(k)] = find(m)
    groups = {}
    for k, (i, _, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    return [(rows[k][0], n[k], min((i for i in groups[find(k)] if i is not None), default=None)) for k in range(len(rows))]


def test_shells_and_decoder():
    shells = e8_shells()
    assert len(shells) == 2400 and sorted({round(x) for x in (shells**2).sum(axis=1)}) == [2, 4]
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 8))
    c = e8_decode(x)
    gap = ((x - c) ** 2).sum(axis=1)
    assert (gap <= 1 + 1e-9).all()
    others = ((x[:, None] - c[:, None] - shells[None]) ** 2).sum(axis=2)
    assert (gap[:, None] <= others + 1e-9).all()


def test_links_match_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(60):
        v = rng.standard_normal(20)
        v /= np.linalg.norm(v)
        rows.append((len(rows), (v * rng.uniform(0.1, 9)).tolist(), k % 3))
        for _ in range(k % 5):
            rows.append((len(rows), near(rng, v, rng.uniform(0.1, 0.3)).tolist(), k % 3))
    v = rows[0][1]
    rows += [(900, v, 0), (901, v, 0), (902, v, None), (903, v, 1), (904, None, 0), (905, [0.0] * 20, 0), (906, [1.0, None] + [0.0] * 18, 0), (907, [float("nan")] + [1.0] * 19, 0), (908, [float("inf")] + [1.0] * 19, 0), (909, [], 0), (910, [1.0, 0.0], 0), (911, [2.0, 0.0], 0), (912, [1e30] + [0.0] * 19, 0), (913, [3e30] + [0.0] * 19, 0), (901, rows[4][1], 1)]
    f32 = [(i, None if x is None else [None if c is None else float(np.float32(c)) for c in x], l) for i, x, l in rows]
    out = lattice_links(frame(spark, rows).repartition(5))
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in out.collect())
    assert got == sorted(expected_links(f32))
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.collect())


def test_links_in_split_cells(spark):
    """A group of near copies far over the block size, cut into many units, loses no link."""
    rng = np.random.default_rng(1)
    v = rng.standard_normal(16)
    v /= np.linalg.norm(v)
    rows = [(i, near(rng, v, rng.uniform(0, 0.12)).tolist(), 1) for i in range(120)]
    f32 = [(i, [float(np.float32(c)) for c in x], l) for i, x, l in rows]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in lattice_links(frame(spark, rows), block=16).collect())
    assert got == sorted(expected_links(f32))


def test_links_of_nothing(spark):
    assert lattice_links(frame(spark, [])).collect() == []
    (row,) = lattice_links(frame(spark, [(None, [1.0, 2.0], 1)])).collect()
    assert (row.vec_id, row.n_links, row.component_id, row.kept) == (None, 0, None, False)


def test_hadamard_is_orthogonal():
    h = hadamard(np.eye(8))
    assert np.allclose(h @ h.T, np.eye(8))


def brute(rows, k):
    ok = [(i, np.array(v, np.float64)) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in ok:
        if q % 20 == 0:
            found = sorted((-float((x * y).sum()), i) for i, y in ok if i != q and len(y) == len(x))
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


@pytest.mark.parametrize("depth", [0, 1, 2])
def test_search_is_exact_with_all_probes(spark, depth):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(c)) for c in rng.standard_normal(12) * rng.uniform(0.2, 3)], 0) for i in range(150)]
    rows += [(200 + i, rows[3][1], 0) for i in range(30)]  # ties
    rows += [(300, None, 0), (320, [0.0] * 12, 0), (340, [None] * 12, 0), (360, [1.0, 2.0], 0), (361, [0.5, 1.0], 0), (None, rows[0][1], 0)]
    got = {}
    for r in search(frame(spark, rows).repartition(3), F.col("vec_id") % 20 == 0, k=20, tables=2, slack=-100.0, block=32, depth=depth).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, 20)
    assert set(got) == {q for q, x in want.items() if x}
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1))
        assert [i for _, i, _ in found] == [i for i, _ in want[q]]
        assert [s for _, _, s in found] == pytest.approx([s for _, s in want[q]], rel=1e-12)


@pytest.mark.parametrize("depth", [0, 1, 2])
def test_search_recall(spark, depth):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = {}
    for r in search(frame(spark, rows), F.col("vec_id") % 20 == 0, depth=depth).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(rows, 20)
    hits = sum(len(got[q] & {i for i, _ in found}) for q, found in want.items())
    assert hits >= 0.9 * 20 * len(want)


@pytest.mark.parametrize("kind", ["one long", "log-normal"])
def test_search_recall_on_skewed_norms(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= np.exp(0.5 * rng.standard_normal((1500, 1))) if kind == "log-normal" else np.where(np.arange(1500) == 7, 1000.0, 1.0)[:, None]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x.astype(np.float32))]
    got = {}
    for r in search(frame(spark, rows), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(rows, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len(got[q] & {i for i, _ in found}) for q, found in want.items())
    assert hits >= 0.95 * 20 * len(want)


def test_ties_go_to_the_smaller_ids(spark):
    """Very many different vectors of one inner product, in both ways of search."""
    rows = [(0, [1.0, 0.0, 0.0], 0)] + [(i, [0.5, float(np.float32(math.cos(i))), float(np.float32(math.sin(i)))], 0) for i in range(1, 600)]
    for slack in (-100.0, 100.0):
        out = search(frame(spark, rows).repartition(4), F.col("vec_id") == 0, slack=slack, block=64).collect()
        assert sorted((r.rank, r.vec_id, r.score) for r in out) == [(k, k, 0.5) for k in range(1, 21)]


def test_the_share_compared_falls_with_the_rows():
    """Recall and share of the rows compared, on directions without any order."""
    rng = np.random.default_rng(11)
    shares = []
    for n in (500, 2000, 8000):
        x = rng.standard_normal((n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        p = polytope_search.plan(64, {0: n}, 20, 4, 0.3, 4096, None)
        met = polytope_search.passes(x[:100], x, p, list(range(6)), 4, 7)
        product = x[:100] @ x.T
        top = np.argsort(-product, axis=1)[:, 1:21]
        assert np.take_along_axis(met, top, axis=1).mean() >= 0.92
        shares.append(met.mean())
    assert shares[0] < 0.45 and shares[1] < 0.25 and shares[2] < 0.16


def test_search_of_few_rows_is_whole(spark):
    """A query that meets under k + 1 rows is searched among all."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(c)) for c in rng.standard_normal(64)], 0) for i in range(21)]
    rows += [(100 + i, [float(np.float32(c)) for c in rng.standard_normal(3)], 0) for i in range(5)]
    got = {}
    for r in search(frame(spark, rows), F.col("vec_id") % 20 == 0, block=16).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in brute(rows, 20).items()}


def test_search_of_nothing(spark):
    assert search(frame(spark, []), F.col("vec_id") % 20 == 0).collect() == []
    assert search(frame(spark, [(0, [1.0], 0)]), F.col("vec_id") % 20 == 0).collect() == []
