"""All correlations and regressions of many columns from one pass."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = ("n", "mean", "square", "product")
_SHAPE = ", ".join(f"{p} array<double>" for p in PARTS)


@dataclass
class Moments:
    """For each pair of columns (i, j), over the rows in which both are known: their number, the mean of i, the sum of squares of i and the sum of products, both
    about the means. Square matrices, merged pairwise without cancellation however large the means are."""

    n: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    product: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        """Of rows of a matrix with NaN for what is unknown."""
        known = np.isfinite(x)
        mask = known.astype(np.float64)
        shift = np.where(known, x, 0.0).sum(axis=0) / np.maximum(mask.sum(axis=0), 1)
        y = np.where(known, x - shift, 0.0)
        n = mask.T @ mask
        s = y.T @ mask
        some = np.maximum(n, 1)
        return cls(n, np.where(n > 0, shift[:, None] + s / some, 0.0), np.maximum((y * y).T @ mask - s * s / some, 0.0), y.T @ y - s * s.T / some)

    def merged(self, o: Moments) -> Moments:
        n = self.n + o.n
        some = np.maximum(n, 1)
        step = np.where((self.n > 0) & (o.n > 0), o.mean - self.mean, 0.0)
        weight = self.n * o.n / some
        mean = np.where(o.n == 0, self.mean, np.where(self.n == 0, o.mean, self.mean + step * o.n / some))
        return Moments(n, mean, self.square + o.square + step * step * weight, self.product + o.product + step * step.T * weight)

    def correlation(self) -> np.ndarray:
        """Pearson's r of each pair; NaN where a column does not vary."""
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where((self.square > 0) & (self.square.T > 0), self.product / np.sqrt(self.square * self.square.T), np.nan)

    def regression(self) -> tuple[np.ndarray, np.ndarray]:
        """(slope, intercept) of column j on column i at [i, j]."""
        with np.errstate(invalid="ignore", divide="ignore"):
            slope = np.where(self.square > 0, self.product / self.square, np.nan)
        return slope, self.mean.T - slope * self.mean

    def least_squares(self, y: int, xs: list[int]) -> tuple[np.ndarray, float]:
        """(coefficients, intercept) of column y on several, by the factorised products of scaled columns; moments must be those of complete rows. Columns that
        say the same share their weight."""
        scale = np.sqrt(np.where(np.diag(self.square)[xs] > 0, np.diag(self.square)[xs], 1.0))
        value, axis = np.linalg.eigh(self.product[np.ix_(xs, xs)] / scale[:, None] / scale[None, :])
        keep = value > 1e-10 * max(value.max(initial=0.0), 1e-300)
        b = axis[:, keep] @ ((axis[:, keep].T @ (self.product[xs, y] / scale)) / value[keep]) / scale
        return b, float(self.mean[y, y] - b @ np.diag(self.mean)[xs])


def _merge(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    whole: Moments | None = None
    for batch in batches:
        for row in zip(*(batch.column(p).to_pylist() for p in PARTS)):
            own = Moments(*(np.array(v).reshape(d, d) for v in row))
            whole = own if whole is None else whole.merged(own)
    if whole is not None:
        yield _row(whole)


def _row(m: Moments) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([getattr(m, p).ravel().tolist()], pa.list_(pa.float64())) for p in PARTS], names=list(PARTS))


def moments(df: DataFrame, columns: list[str], complete: bool = False, fan: int = 64) -> Moments:
    """One scan, a few matrices from each task, merged by ``fan`` at a time over the cluster until one task's are left. Null, NaN and infinite values are unknown; with
    ``complete`` a row that lacks one value counts for none."""
    d = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: Moments | None = None
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns], axis=1)
            if complete:
                x = x[np.isfinite(x).all(axis=1)]
            if len(x):
                own = Moments.of(x)
                whole = own if whole is None else whole.merged(own)
        if whole is not None:
            yield _row(whole)

    told = df.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns))).mapInArrow(run, _SHAPE)
    parts = df.rdd.getNumPartitions()
    while parts > fan:
        parts = -(-parts // fan)
        told = told.repartition(parts).mapInArrow(lambda b: _merge(b, d), _SHAPE)
    whole = Moments(*(np.zeros((d, d)) for _ in PARTS))
    for r in told.collect():  # ``fan`` rows at most
        whole = whole.merged(Moments(*(np.array(r[p]).reshape(d, d) for p in PARTS)))
    return whole


def matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, n, r, slope, intercept) for each pair of different columns: y on x, over rows in which both are known."""
    m = moments(df, columns)
    r, (slope, intercept) = m.correlation(), m.regression()
    plain = lambda v: None if np.isnan(v) else float(v)
    rows = [
        (x, y, int(m.n[i, j]), plain(r[i, j]), plain(slope[i, j]), plain(intercept[i, j]))
        for i, x in enumerate(columns) for j, y in enumerate(columns) if i != j
    ]
    return df.sparkSession.createDataFrame(rows, "x string, y string, n long, r double, slope double, intercept double")
