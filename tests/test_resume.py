"""Going on with an output: filters spare exchanges and never lose or repeat a row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.plans import pipelines
from tessera.operators import translate
from tessera.sources.resume import ResumableOutput, positions


def rows(spark, a, b):
    return spark.range(a, b).select(F.concat(F.lit("k"), "id").alias("data_id"), F.col("id").alias("n"))


def ids(df):
    return sorted(r.n for r in df.collect())


@pytest.mark.parametrize("sizes", [{}, {"bits": 8}, {"per": 40, "bits": 1024}, {"most": 10}])
def test_remaining_rows(spark, tmp_path, sizes):
    """The same rows with good filters, with filters full of false positives, with many and with none."""
    out = ResumableOutput(spark, str(tmp_path / "o"), "data_id", **sizes)
    assert ids(out.remaining(rows(spark, 0, 9))) == list(range(9)) and out.keys().count() == 0
    out.write(rows(spark, 0, 150).repartition(3))
    out.write(rows(spark, 140, 200).unionByName(spark.createDataFrame([(None, -1)], "data_id string, n long")))
    more = rows(spark, 100, 400).unionByName(spark.createDataFrame([(None, -5), ("k7", 7), ("new", 1000), ("new", 1000)], "data_id string, n long"))
    assert ids(out.remaining(more.repartition(4))) == [-5, *range(200, 400), 1000, 1000]
    new, maybe = out.split(more)
    assert ids(new.unionByName(maybe)) == ids(more)
    if not sizes:  # hardly more rows are exchanged than are done
        assert maybe.count() <= 105 and new.count() >= 199
    if sizes.get("bits") == 8 or sizes.get("most"):
        assert new.count() <= 1
    assert spark.read.json(str(tmp_path / "o")).count() == 211


def test_an_unfinished_batch_is_indexed(spark, tmp_path):
    out = ResumableOutput(spark, str(tmp_path / "o"), "data_id")
    rows(spark, 0, 20).write.json(str(tmp_path / "o" / "batch=00ff"))  # the run ended here
    assert ids(out.remaining(rows(spark, 10, 30))) == list(range(20, 30))
    assert out.keys().count() == 20


def test_filter_positions():
    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, (2, 1000))
    at = positions(h[0], h[1], 1 << 14)
    told = np.zeros(1 << 14, bool)
    told[at[:900].ravel()] = True
    assert told[at[:900]].all() and told[at[900:]].all(axis=1).sum() <= 5


def test_translation_goes_on(spark, tmp_path):
    docs = spark.createDataFrame([(f"a_b_en_{k}", f"question {k}", f"answer {k}") for k in range(6)], "data_id string, question string, answer string")
    out, task = ResumableOutput(spark, str(tmp_path / "t"), "data_id"), translate.TASKS["gsm8k"]
    out.write(pipelines.translate_docs(docs.limit(2), task, None, "de", done=out))
    left = pipelines.translate_docs(docs, task, None, "de", done=out)
    assert left.count() == 4
    out.write(left)
    assert pipelines.translate_docs(docs, task, None, "de", done=out).count() == 0
