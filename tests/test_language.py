"""The trained language identifier: counts against plain Python, accuracy and calibration on rows it has not seen."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import language

DATA = "/root/testdata/sf0.01/documents.parquet"


def slow_grams(text):
    plain = " ".join("".join(" " if c.isdigit() else c for c in text.lower()).split())
    return [plain[i : i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1) if plain[i : i + n].strip()]


def slow_slot(gram, bits=15):
    part = 0
    for c in gram:
        part = (part * 0x9E3779B97F4A7C15 + (ord(c) + 1) * 0xBF58476D1CE4E5B9) % (1 << 64)
    return ((part ^ (part >> 29)) * 0x94D049BB133111EB) % (1 << 64) >> (64 - bits)


def test_slots_are_those_of_the_grams():
    texts = ["Ab 12 c", "", "ÉA\n é", "  ", "aba"]
    found, cut = language.gram_slots(texts)
    assert np.diff(cut).tolist() == [len(slow_grams(t)) for t in texts]
    for i, t in enumerate(texts):
        assert sorted(found[cut[i] : cut[i + 1]].tolist()) == sorted(map(slow_slot, slow_grams(t)))


def test_weights_match_brute_force(spark):
    rows = [("the cat sat", "en"), ("the dog", "en"), ("der hund", "de"), ("die katze sitzt", "de"), (None, "de"), ("le chat", None), ("ein tag", "de"), ("a day", "en")] * 3
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    model = language.fit_language(df, aside=0, slots=1 << 20)
    used = [(r.text, r.lang) for r in df.where("text is not null and lang is not null").where(F.pmod(F.xxhash64("text"), F.lit(10)) != 0).collect()]
    assert model.names == ["de", "en"]
    counts = {n: Counter(g for t, k in used if k == n for g in slow_grams(t)) for n in model.names}

    def log_p(n, g):
        return math.log((counts[n][g] + 0.5) / (sum(counts[n].values()) + 0.5 * (1 << 20)))

    for text in ("the hund", "zz", ""):
        grams = slow_grams(text)
        want = [sum(log_p(n, g) for g in grams) + math.log(sum(k == n for _, k in used) / len(used)) for n in model.names]
        assert model.scores([text])[0].tolist() == pytest.approx(want, rel=1e-4)


def test_held_out_rows(spark):
    docs = spark.read.parquet(DATA)
    aside = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = language.fit_language(docs.where(~aside))
    told = docs.where(aside).select("lang", "text").withColumn("x", model.identify(F.col("text"))).select("lang", "x.*").toPandas()
    told.columns = ["lang", "guess", "confidence"]
    right = told.lang == told.guess
    assert len(told) > 200 and right.mean() >= 0.98 and abs(told.confidence.mean() - right.mean()) < 0.02
    short = docs.where(aside).select("lang", F.substring("text", 1, 40).alias("text")).withColumn("x", model.identify(F.col("text"))).select("lang", "x.*").toPandas()
    short.columns = ["lang", "guess", "confidence"]
    right = short.lang == short.guess
    assert right.mean() >= 0.95 and abs(short.confidence.mean() - right.mean()) < 0.05


def test_identifier_of_odd_rows(spark):
    df = spark.createDataFrame([("the cat", "en"), ("le chat", "fr")] * 10, "text string, lang string")
    odd = spark.createDataFrame([(None,), ("",), ("12 !",), ("the cat",)], "text string")
    told = [tuple(r.x) for r in odd.withColumn("x", language.fit_language(df, aside=0).identify(F.col("text"))).collect()]
    assert told[:3] == [(None, 0.0)] * 3 and told[3][1] > 0
    none = language.fit_language(df.limit(0))
    assert [tuple(r.x) for r in odd.withColumn("x", none.identify(F.col("text"))).collect()] == [(None, 0.0)] * 4
