"""Co-moments of many columns at once against numpy, with unknown values and large means."""

import numpy as np
import pandas as pd
import pytest

from tessera.operators import moments


def table(spark, x, parts=5):
    return spark.createDataFrame(pd.DataFrame(x, columns=[f"x{i}" for i in range(x.shape[1])])).repartition(parts)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 4))
    x[:, 1] = 0.5 * x[:, 0] + 0.1 * x[:, 1] + 1e9  # a large mean
    x[:, 3] = 2.0
    x[rng.random(x.shape) < 0.1] = np.nan
    x[7, 0] = np.inf
    return x


def test_matrix_against_numpy(spark, data):
    got = {(r.x, r.y): r for r in moments.matrix(table(spark, data), ["x0", "x1", "x2", "x3"]).collect()}
    for (a, b), r in got.items():
        i, j = int(a[1]), int(b[1])
        both = data[np.isfinite(data[:, [i, j]]).all(axis=1)]
        assert r.n == len(both)
        u, v = both[:, i] - both[:, i].mean(), both[:, j] - both[:, j].mean()
        if 3 in (i, j):
            assert r.r is None and (r.slope is None) == (i == 3)
            continue
        assert r.r == pytest.approx(u @ v / np.sqrt((u @ u) * (v @ v)), abs=1e-6)
        assert r.slope == pytest.approx(u @ v / (u @ u), rel=1e-5)
        assert r.intercept == pytest.approx(both[:, j].mean() - r.slope * both[:, i].mean(), rel=1e-6, abs=1e-2)


def test_one_scan_and_any_partitions(spark, data):
    scans = spark.sparkContext.accumulator(0)

    def count(batches):
        scans.add(1)
        yield from batches

    df = table(spark, data, 1)
    one = moments.moments(df.mapInArrow(count, df.schema), ["x0", "x1", "x2"])
    assert scans.value == 1
    many = moments.moments(table(spark, data, 9), ["x0", "x1", "x2"], fan=2)
    assert np.array_equal(one.n, many.n) and np.allclose(one.product, many.product, atol=1e-6) and np.allclose(one.mean, many.mean)


def test_least_squares(spark, data):
    m = moments.moments(table(spark, data), ["x0", "x1", "x2", "x0"], complete=True)
    b, at = m.least_squares(2, [0, 1])
    full = data[np.isfinite(data[:, :3]).all(axis=1)]
    centred = full[:, :3] - full[:, :3].mean(axis=0)
    want = np.linalg.lstsq(centred[:, :2], centred[:, 2], rcond=None)[0]
    assert b == pytest.approx(want, rel=1e-5, abs=1e-9) and at == pytest.approx(full[:, 2].mean() - want @ full[:, :2].mean(axis=0), rel=1e-4, abs=1.0)
    twice, _ = m.least_squares(2, [0, 3])  # the same column twice
    once, _ = m.least_squares(2, [0])
    assert twice.sum() == pytest.approx(once[0]) and twice[0] == pytest.approx(twice[1])
    nothing = moments.moments(table(spark, data).limit(0), ["x0", "x1"])
    assert nothing.n.sum() == 0 and np.isnan(nothing.correlation()).all()
