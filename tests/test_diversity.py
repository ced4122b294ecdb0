"""Tag statistics kept by dataset: merged reports against plain counts."""

from collections import Counter

import numpy as np
import pytest

from tessera.operators.diversity import DiversityStore


def dataset(spark, seed, n, first=0):
    rng = np.random.default_rng(seed)
    rows = [(float(i), None if i % 9 == 0 else [f"t{first + int(k)}" for k in rng.zipf(1.6, rng.integers(0, 6)) if k < 4000] + ([None] if i % 5 == 0 else [])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "score double, tags array<string>").repartition(3)


def test_reports_of_merged_datasets(spark, tmp_path):
    store, plain, sizes = DiversityStore(spark, str(tmp_path / "d")), {}, {}
    assert store.report().count() == 0 and store.distinct_tags() == 0 and store.frequent(0.1).count() == 0
    for name, seed, n in (("a", 1, 300), ("b", 2, 500), ("it's/odd", 3, 50)):
        rows, df = dataset(spark, seed, n, 10 * seed)
        store.add(name, df, metrics=("score",))
        plain[name], sizes[name] = Counter(t for _, x in rows for t in x or () if t), n
    got = {r.dataset: r for r in store.report().collect()}
    for name, c in plain.items():
        r = got[name]
        assert (r["size"], r.occurrences, r.tags) == (sizes[name], sum(c.values()), len(c))
        assert r.tag_diversity == pytest.approx(len(c) / sizes[name]) and r.inverse_frequency == pytest.approx(sizes[name] * len(c) / (100 * sum(c.values())))
        assert r.means["score"] == pytest.approx((sizes[name] - 1) / 2)
    for some in (None, ["a", "b"]):
        whole = sum((c for n, c in plain.items() if some is None or n in some), Counter())
        assert store.distinct_tags(some) == pytest.approx(len(whole), rel=0.06)
        for share in (0.002, 0.05):
            want = {t: n for t, n in whole.items() if n >= share * sum(whole.values())}
            assert {r.tag: r.n for r in store.frequent(share, some).collect()} == want


def test_adding_reads_only_its_dataset_and_replaces(spark, tmp_path):
    store = DiversityStore(spark, str(tmp_path / "d"))
    store.add("a", spark.createDataFrame([(["x", "y"],), (None,)], "tags array<string>"))
    before = store.rows().collect()
    store.add("b", spark.createDataFrame([(["x"],)], "tags array<string>"))
    assert [r for r in store.rows().collect() if r.dataset == "a"] == before  # untouched
    store.add("a", spark.createDataFrame([], "tags array<string>"))
    got = {r.dataset: (r["size"], r.tags, r.tag_diversity) for r in store.report().collect()}
    assert got == {"a": (0, 0, None), "b": (1, 1, 1.0)}
    assert [tuple(r) for r in store.frequent(0.5).collect()] == [("x", 1)] and store.distinct_tags() == 1
