"""A trained text embedder (U4): hashed TF-IDF features projected on their leading directions, found by a randomized SVD in Spark."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.language import gram_keys
from tessera.tables import Tables

#: Features, and those that lie together in one row of a partial sum.
FEATURES, STRIP = 1 << 13, 256
#: Texts whose n-grams are counted at once, and characters of theirs; rows of the table of features that are multiplied at once.
TEXTS, LETTERS, ROWS = 64, 1 << 17, 256


def features(texts: list[str | None], size: int = FEATURES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, counts, offsets): the different hashed character n-grams of each text."""
    keys = gram_keys([t or "" for t in texts], 4, size)
    n = np.bincount(keys, minlength=len(texts) * size + 1)[:-1]
    keys = np.flatnonzero(n)
    return keys % size, n[keys].astype(np.float64), np.searchsorted(keys, np.arange(len(texts) + 1) * size)


def stretches(texts: list[str | None]) -> Iterator[slice]:
    """Of at most ``TEXTS`` texts, and of no more once they have ``LETTERS`` characters."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= LETTERS or i + 1 - first == TEXTS or i + 1 == len(texts):
            yield slice(first, i + 1)
            first, held = i + 1, 0


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2^32: how many bytes each takes, then all lowest bytes, then the next; small ones compress to about a byte each."""
    wide = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return bytes([wide]) + numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T[:wide].tobytes()


def unpacked(told: bytes) -> np.ndarray:
    return unpacked_rows(pa.array([told], pa.binary()))[0]


def unpacked_rows(told: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, offsets) of a column of ``packed`` rows without nulls, all rows at once."""
    rows = [np.frombuffer(r.as_buffer(), np.uint8) for r in told]
    wide = [int(r[0]) for r in rows]
    size = [(len(r) - 1) // w for r, w in zip(rows, wide)]
    at = np.cumsum([0, *size])
    out, none = np.zeros(at[-1], np.int64), np.zeros(max(size, default=0), np.uint8)
    for plane in range(max(wide, default=0)):
        out += np.concatenate([r[1 + plane * n : 1 + (plane + 1) * n] if plane < w else none[:n] for r, w, n in zip(rows, wide, size)]).astype(np.int64) << (8 * plane)
    return out, at


def dense(slots: np.ndarray, n: np.ndarray, at: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """(texts, features): TF-IDF values, each text of unit length."""
    out = np.zeros((len(at) - 1, len(idf)))
    row = np.repeat(np.arange(len(out)), np.diff(at))
    value = (1 + np.log(np.maximum(n, 1))) * idf[slots]
    size = np.sqrt(np.bincount(row, weights=value.astype(np.float64) ** 2, minlength=len(out)))
    out[row, slots] = value / np.maximum(size, 1e-300)[row]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; those of zeros stay."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def counted(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Some rows of the table of features at a time, with their (slots, counts, offsets)."""
    for first in range(0, batch.num_rows, ROWS):
        told = batch.slice(first, ROWS)
        gaps, at = unpacked_rows(told.column("gaps"))
        total = np.concatenate([[0], np.cumsum(gaps)])
        slots = total[1:] - np.repeat(total[at[:-1]], np.diff(at))  # a text's slots ascend; its first counts from 0
        yield told, (slots, unpacked_rows(told.column("n"))[0].astype(np.float64), at)


@dataclass
class TextEmbedder:
    """``idf`` weighs the features, ``axes`` (features x rank) are the leading right singular vectors of the weighted corpus, ``strength`` their singular values."""

    idf: np.ndarray
    axes: np.ndarray
    strength: np.ndarray

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        """Unit vectors; zero for a text without features."""
        return unit(dense(*features(texts, len(self.idf)), self.idf) @ self.axes)

    def embed(self, df: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame:
        model = self

        @F.pandas_udf("array<float>")
        def run(texts: pd.Series) -> pd.Series:
            out: list[np.ndarray] = []
            for some in stretches(told := texts.tolist()):
                out += list(model.vectors(told[some]).astype(np.float32))
            return pd.Series(out)

        return df.withColumn(out_col, run(F.col(text_col)))


def feature_table(df: DataFrame, text_col: str, tables: Tables, *keep: str, size: int = FEATURES) -> DataFrame:
    """(gaps, n and the columns to ``keep``): each text's features as gaps and counts, about two bytes for each at most. Null and empty texts have none."""
    rows = df.select(*keep, F.col(text_col).alias("text"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for some in stretches(texts):
                slots, n, at = features(texts[some], size)
                gaps = np.diff(slots, prepend=0)
                gaps[at[:-1][np.diff(at) > 0]] = slots[at[:-1][np.diff(at) > 0]]
                told = [pa.array([packed(x[a:b]) for a, b in zip(at, at[1:])], pa.binary()) for x in (gaps, n)]
                own = [batch.column(c).slice(some.start, some.stop - some.start) for c in keep]
                yield pa.RecordBatch.from_arrays([*own, *told], names=[*keep, "gaps", "n"])

    shape = ", ".join(filter(None, [_shape(rows, *keep), "gaps binary, n binary"]))
    return tables.put(rows.mapInArrow(sparse, shape), compression="zstd")


def fit_embedder(df: DataFrame, text_col: str, rank: int = 64, size: int = FEATURES, power: int = 2, over: int = 16, seed: int = 1) -> TextEmbedder:
    """Of all rows: one pass counts in how many texts a feature occurs, ``power`` passes multiply a thin matrix by the corpus and its transpose, the last one by the corpus alone.

    A task sums strips of features x (rank + over) over its rows; strips are added up by their number, each in a task of its own, so neither a task nor the driver, which makes the thin
    matrix orthogonal, ever holds more than features x (rank + over). The passes read the texts' features from a table (``feature_table``).
    """
    tables = Tables(df.sparkSession)
    model = _fit(feature_table(df, text_col, tables, size=size), lambda told: told, rank, size, power, over, seed)[0]
    tables.clear()
    return model


def fit_and_embed(df: DataFrame, id_col: str, text_col: str, out_col: str = "vector", rank: int = 64, size: int = FEATURES, power: int = 2, over: int = 16, seed: int = 1) -> tuple[TextEmbedder, DataFrame]:
    """``fit_embedder``, and a table (id_col, out_col) of the same rows embedded: the last pass's products, turned to the axes, so no text is read twice."""
    tables, kept = Tables(df.sparkSession), Tables(df.sparkSession)
    table = feature_table(df, text_col, tables, id_col, size=size)
    model, told, turn = _fit(table, tables.put, rank, size, power, over, seed, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(_matrix(batch.column("y"), len(turn)) @ turn).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), _lists(x)], names=[id_col, out_col])

    out = kept.put(told.mapInArrow(run, f"{_shape(table, id_col)}, `{out_col}` array<float>"))
    tables.clear()
    return model, out


def _shape(df: DataFrame, *names: str) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _matrix(column: pa.Array, wide: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, wide)


def _fit(table: DataFrame, keep: Callable[[DataFrame], DataFrame], rank: int, size: int, power: int, over: int, seed: int, *ids: str) -> tuple[TextEmbedder, DataFrame, np.ndarray]:
    """The model of a ``feature_table``; its rows (ids, y) by the last thin matrix, which ``keep`` may write before they are read; and what turns them to the model's axes."""

    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(size, np.int64), 0
        for batch in batches:
            for _, (slots, _, at) in counted(batch):
                total += np.bincount(slots, minlength=size)
                count += len(at) - 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some.tolist()], pa.int32()), pa.array([count, *total[some].tolist()], pa.int64())], names=["slot", "n"])

    df_ = {r["slot"]: r["n"] for r in table.select("gaps", "n").mapInArrow(occurring, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()}  # a number for each feature
    texts = df_.pop(-1, 0)
    idf = np.zeros(size)
    for slot, n in df_.items():
        idf[slot] = math.log((1 + texts) / (1 + n)) + 1.0
    wide = min(rank + over, max(1, len(df_)))
    thin = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, wide)) * (idf > 0)[:, None])[0]

    shape = "strip int, told binary"

    def strips(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(total), STRIP):
            if total[k : k + STRIP].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[k : k + STRIP].tobytes()], pa.binary())], names=["strip", "told"])

    def added(parts: DataFrame, rows: int) -> np.ndarray:
        """(rows, wide): the sum of the tasks' strips."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, told in zip(batch.column("strip").to_pylist(), batch.column("told").to_pylist()):
                    sums[k] = sums.get(k, 0.0) + np.frombuffer(told).reshape(-1, wide)
            for k, told in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([told.tobytes()], pa.binary())], names=["strip", "told"])

        out = np.zeros((rows, wide))
        for r in parts.repartition("strip").mapInArrow(add, shape).collect():
            out[r["strip"] : r["strip"] + STRIP] = np.frombuffer(r["told"]).reshape(-1, wide)
        return out

    def times(q: np.ndarray) -> np.ndarray:
        """The corpus's transpose by the corpus by ``q``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size, wide))
            for batch in batches:
                for _, found in counted(batch):
                    x = dense(*found, idf)
                    total += x.T @ (x @ q)
            yield from strips(total)

        return added(table.select("gaps", "n").mapInArrow(run, shape), size)

    for _ in range(power):
        thin = np.linalg.qr(times(thin))[0]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, found in counted(batch):
                y = (dense(*found, idf) @ thin).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ids), _lists(y)], names=[*ids, "y"])

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((wide, wide))
        for batch in batches:
            y = _matrix(batch.column("y"), wide)
            total += y.T @ y
        yield from strips(total)

    told = keep(table.select(*ids, "gaps", "n").mapInArrow(project, ", ".join(filter(None, [_shape(table, *ids), "y array<float>"]))))
    value, axis = np.linalg.eigh(added(told.select("y").mapInArrow(squares, shape), wide))
    first = np.argsort(-value)[:rank]
    turn = axis[:, first]
    return TextEmbedder(idf.astype(np.float32), (thin @ turn).astype(np.float32), np.sqrt(np.maximum(value[first], 0.0))), told, turn
