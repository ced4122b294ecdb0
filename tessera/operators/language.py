"""A trained language identifier (U5): naive Bayes over hashed character n-grams, counted in Spark."""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: n-grams of one to so many characters share so many slots; a model has one number for each slot and language.
LONGEST, SLOTS = 3, 1 << 15
_BREAK = 0x0A  # between texts and in place of white space runs' ends; no n-gram of it counts


@functools.cache
def _blanks() -> np.ndarray:
    """Which code points count as blanks: white space and digits."""
    return np.array([c.isspace() or c.isdigit() for c in map(chr, range(sys.maxunicode + 1))])


def _plain(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, texts' numbers): the texts in lower case, white space and digits being one blank a run, none at the ends, each with a break behind it."""
    low = [t.lower() for t in texts]
    size = np.array([len(t) + 1 for t in low], np.int64)
    codes = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = _blanks()[codes]
    codes = np.where(blank, np.uint32(0x20), codes)
    ends = np.cumsum(size) - 1
    codes[ends] = _BREAK
    again = np.concatenate([[True], blank])[:-1]  # after a blank or a break
    keep = ~(blank & again)
    keep[ends] = True
    row = np.repeat(np.arange(len(texts)), size)[keep]
    codes = codes[keep]
    last = (codes[:-1] == 0x20) & (codes[1:] == _BREAK)  # a text's last blank
    keep = np.concatenate([~last, [True]]) if len(codes) else np.zeros(0, bool)
    return codes[keep].astype(np.uint64), row[keep]


def gram_keys(texts: list[str], longest: int = LONGEST, slots: int = SLOTS) -> np.ndarray:
    """Text's number * slots + slot of every n-gram of the texts in lower case, white space and digits being one blank a run; that of no text, len(texts) * slots, for those of blanks
    only or over two texts."""
    codes, row = _plain(texts)
    first, none = row * slots, len(texts) * slots
    told = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    ends, blank = codes == _BREAK, codes <= 0x20
    part = np.zeros(len(codes), np.uint64)
    bad, empty = np.zeros(len(codes), bool), np.ones(len(codes), bool)
    out = []
    for n in range(1, longest + 1):
        part = part[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15)
        part += told[n - 1 :]
        bad = bad[: len(part)] | ends[n - 1 :]
        empty = empty[: len(part)] & blank[n - 1 :]
        mixed = part >> np.uint64(29)
        mixed ^= part
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed >>= np.uint64(64 - int(slots).bit_length() + 1)
        key = mixed.view(np.int64)
        key += first[: len(part)]
        key[bad | empty] = none
        out.append(key)
    return np.concatenate(out)


def gram_slots(texts: list[str], longest: int = LONGEST, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """(slots, offsets): the slots of ``gram_keys`` by text."""
    keys = gram_keys(texts, longest, slots)
    keys = keys[keys < len(texts) * slots]
    owner = keys // slots
    order = np.argsort(owner, kind="stable")
    return keys[order] % slots, np.searchsorted(owner[order], np.arange(len(texts) + 1))


def _counts(batches: Iterator[pa.RecordBatch], longest: int, slots: int) -> Iterator[pa.RecordBatch]:
    """(lang, slot, n) of a task's rows, summed within it."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for at in range(0, len(texts), 256):
            found, cut = gram_slots(texts[at : at + 256], longest, slots)
            for i, lang in enumerate(langs[at : at + 256]):
                sums.setdefault(lang, np.zeros(slots, np.int64))
                sums[lang] += np.bincount(found[cut[i] : cut[i + 1]], minlength=slots)
    for lang, n in sums.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some.astype(np.int32)), pa.array(n[some])], names=["lang", "slot", "n"])


@dataclass
class LanguageModel:
    names: list[str]
    weights: np.ndarray  # log probabilities of slots by language
    prior: np.ndarray
    temperature: float = 1.0

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Log probabilities of each language, up to a number of the text's own."""
        slots = self.weights.shape[1]
        found, cut = gram_slots([t or "" for t in texts], slots=slots)
        total = np.concatenate([np.zeros((1, len(self.names))), np.cumsum(self.weights[:, found].T, axis=0)])
        return total[cut[1:]] - total[cut[:-1]] + self.prior

    def identify(self, text: Column) -> Column:
        """struct<lang, confidence>; null and 0 for null texts and those without a letter or other sign."""
        model = self

        @F.pandas_udf("lang string, confidence double")
        def run(texts: pd.Series) -> pd.DataFrame:
            out: list[pd.DataFrame] = [pd.DataFrame({"lang": pd.Series([], dtype=object), "confidence": pd.Series([], dtype=float)})]
            for at in range(0, len(texts), 128):
                part = texts.iloc[at : at + 128].tolist()
                known = np.array([bool(t) and any(c.isalpha() for c in t) for t in part]) & bool(model.names)
                if model.names:
                    p = _softmax(model.scores(part) / model.temperature)
                    best = p.argmax(axis=1)
                    sure, names = p.max(axis=1), np.array(model.names, object)[best]
                else:
                    sure, names = np.zeros(len(part)), np.full(len(part), None, object)
                out.append(pd.DataFrame({"lang": np.where(known, names, None), "confidence": np.where(known, sure, 0.0)}))
            return pd.concat(out[1:] or out, ignore_index=True)

        return run(text)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_language(df: DataFrame, text: str = "text", lang: str = "lang", aside: int = 2000, slots: int = SLOTS, smooth: float = 0.5) -> LanguageModel:
    """Counts the n-grams of all rows with a language but a tenth by hash, of which at most ``aside`` set the temperature of the confidence
    by a few words of each. n-grams overlap, so their sum says too much by a factor, which the temperature is.

    What reaches the driver is one number for each slot and language and those rows; counts are summed within tasks first, so they do not grow with the rows.
    """
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    tenth = F.pmod(F.xxhash64("text"), F.lit(10)) == 0
    told = rows.where(~tenth).mapInArrow(lambda b: _counts(b, LONGEST, slots), "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    docs = {r["lang"]: r["n"] for r in rows.where(~tenth).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(docs)
    counts = np.zeros((len(names), slots))
    place = {n: i for i, n in enumerate(names)}
    counts[[place[x] for x in told.column("lang").to_pylist()], told.column("slot").to_numpy()] = told.column("n").to_numpy()
    weights = np.log((counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * slots)).astype(np.float32) if names else np.zeros((0, slots), np.float32)
    prior = np.log(np.array([docs[n] for n in names], float) / max(1, sum(docs.values())))
    model = LanguageModel(names, weights, prior)
    held = rows.where(tenth).orderBy(F.xxhash64("text", F.lit(1))).limit(aside).collect() if len(names) > 1 else []
    held = [r for r in held if r["lang"] in place]
    if held:
        middle = [r["text"][len(r["text"]) // 2 :][:24] for r in held]  # whole texts leave no doubt to learn from
        z = model.scores(middle)
        y = np.array([place[r["lang"]] for r in held])
        soft = (np.arange(len(names)) == y[:, None]) * (1 - 0.5 / len(y)) + 0.25 / len(y)  # half a count of doubt, or separable rows would ask for 0
        grid = np.exp(np.linspace(np.log(0.05), np.log(100), 77))
        model.temperature = float(grid[np.argmin([-(soft * np.log(_softmax(z / t) + 1e-300)).sum(axis=1).mean() for t in grid])])
    return model
