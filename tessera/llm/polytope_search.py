"""Approximate nearest neighbours by cross-polytope hashing (operator 10).

Rows and queries count by their direction, x / |x|. A table turns them by several pseudo-rotations, each three rounds of random signs and a fast
Hadamard transform, and a row's code is its nearest signed axis in each. A query's score for a code is the sum of its own coordinates along those
axes; it takes as candidates the rows of every code whose score reaches a bound, so it probes the best codes first and as many as
the bound lets through. The bound follows from the number of rows: the more rows, the nearer the k-th neighbour of a query, even among
directions without any order, and the higher its expected score; so the share of rows that a query is compared with falls as the rows grow.
A row longer than most has a large inner product at wide angles too, and passes at a score less by as much as its norm exceeds the one that
three quarters of the rows stay under. Candidates are ranked again by exact inner products on the original vectors in double
precision. A query that meets under k + 1 different vectors is searched among all rows.

While the rows are few, blocks of queries meet blocks of rows, and all tables are looked at there. From ``block`` rows a code on, the leading
rotations of a table are the key of a cell, one more for each time that there are as many rows again for each cell, and a query goes only to cells whose codes can reach the
bound. A cell is cut into blocks of rows and of queries, so no task holds a whole cell. Copies of a vector are searched once;
with ties going to the smaller id only the k + 1 smallest ids of a vector can be among k neighbours, which is exact.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._store import Kept, few_files, runs
from tessera.llm._vectors import directions, keyed, matrices, usable

#: Rows over the usual norm are in groups by doublings of it, the last without an end.
GROUPS = 6


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


@lru_cache(maxsize=256)
def rotation(width: int, number: int, seed: int) -> np.ndarray:
    """A pseudo-rotation as a matrix to multiply rows by."""
    rng = np.random.default_rng([seed, number])
    x = np.eye(width)
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], width))
    return x


def signed(x: np.ndarray, width: int, number: int, seed: int) -> np.ndarray:
    """The coordinates of rows along the signed axes of a pseudo-rotation, the negative ones first."""
    y = (x @ rotation(width, number, seed)[: x.shape[1]]).astype(np.float32)
    return np.hstack([-y, y])


@dataclass(frozen=True)
class Plan:
    """How vectors of one length are searched."""

    width: int  # their length, up to a power of two
    bound: float  # the score that a row of usual norm needs
    usual: float  # the norm that three quarters of the rows stay under, as a binary logarithm
    depth: int  # the rotations of a table that are the key of a cell; 0: one cell with all tables
    groups: tuple[int, ...]  # which groups of norms there are

    def excess(self, log_norms: np.ndarray) -> np.ndarray:
        """By how much norms exceed the usual one, 1 at least."""
        return 2.0 ** np.clip(log_norms - self.usual, 0, 60)

    def group(self, log_norms: np.ndarray) -> np.ndarray:
        """By the class of the norm, so that rounding does not matter."""
        return np.minimum(np.ceil(np.clip(norm_class(log_norms) / 8 - self.usual, 0, None)), GROUPS - 1).astype(np.int64)

    def least(self, group: int) -> float:
        """The lowest score at which a row of the group can pass."""
        return self.bound / 2.0 ** (group + 1 / 16) if group < GROUPS - 1 else -np.inf


def log_norms(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(axis=1)
    return np.log2(most) + np.log2(np.linalg.norm(x / most[:, None], axis=1))


def norm_class(log_norms: np.ndarray) -> np.ndarray:
    """Eight classes to each doubling."""
    return np.floor(log_norms * 8 + 0.5).astype(np.int32)


def largest_coordinate(width: int) -> float:
    """The expected largest coordinate, by size, of a random unit vector."""
    x = np.random.default_rng(0).standard_normal((2000, width))
    return float((np.abs(x).max(axis=1) / np.linalg.norm(x, axis=1)).mean())


def plan(dim: int, rows: dict[int, int], k: int, rotations: int, slack: float, block: int, depth: int | None) -> Plan:
    """``rows`` counts the vectors by an eighth of the binary logarithm of their norms. Among n directions without any order the k-th neighbour of
    another lies at a cosine of about q / sqrt(dim), q being the normal quantile of 1 - k / n, and scores ``rotations`` times
    that cosine times the row's largest coordinate, give or take sqrt(rotations / width); ``slack`` of these deviations are added."""
    width = 1 << max(1, int(np.ceil(np.log2(dim))))
    classes, n = np.array(sorted(rows)), np.array([rows[c] for c in sorted(rows)])
    usual = classes[np.searchsorted(n.cumsum(), 0.75 * n.sum())] / 8
    cosine = min(1.0, NormalDist().inv_cdf(max(0.5, 1 - k / n.sum())) / np.sqrt(dim))
    bound = rotations * cosine * largest_coordinate(width) + slack * np.sqrt(rotations / width)
    if depth is None:
        depth = 0
        while depth < min(rotations, 3) and n.sum() >= block * (2 * width) ** (depth + 1):
            depth += 1
    made = Plan(width, float(bound), float(usual), depth, ())
    return Plan(width, float(bound), float(usual), depth, tuple(sorted(set(made.group(classes / 8).tolist()))))


def _norms(batches):
    """(dim, class, n): how many rows have norms of each class."""
    for batch in batches:
        for _, x in matrices(batch.column("vector")):
            found, n = np.unique(norm_class(log_norms(x)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), x.shape[1], np.int32)), pa.array(found), pa.array(n)], names=["dim", "class", "n"])


CELLS = "vid long, tab int, cell long, dim int, query int"


def _cells(plans: dict[int, Plan], tables: int, rotations: int, seed: int):
    """Rows in their cell of each table, and queries in every cell that may hold a row which they let through."""

    def run(batches):
        for batch in batches:
            keys, asks = batch.column("vid").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            for rows, x in matrices(batch.column("vector")):
                d = x.shape[1]
                p = plans[d]
                for at in range(0, len(rows), 256):
                    some, part = keys[rows[at : at + 256]], x[at : at + 256]
                    ask = asks[rows[at : at + 256]]
                    unit, group = directions(part), p.group(log_norms(part))
                    for t in range(tables if p.depth else 1):
                        if not p.depth:
                            found = [(some, np.zeros(len(some), np.int64), 0), (some[ask], np.zeros(int(ask.sum()), np.int64), 1)]
                        else:
                            ys = [signed(unit, p.width, t * rotations + j, seed) for j in range(rotations)]
                            key = group
                            for y in ys[: p.depth]:
                                key = key * (2 * p.width) + y.argmax(axis=1)
                            found = [(some, key, 0)]
                            score = np.zeros((int(ask.sum()), 1), np.float32)
                            for y in ys[: p.depth]:
                                score = (score[:, :, None] + y[ask][:, None, :]).reshape(len(score), score.shape[1] * y.shape[1])
                            score += sum(y[ask].max(axis=1, keepdims=True) for y in ys[p.depth :]) if p.depth < rotations else 0
                            for g in p.groups:
                                i, cell = np.nonzero(score >= p.least(g) - 1e-6)
                                found.append((some[ask][i], g * (2 * p.width) ** p.depth + cell, 1))
                        for vid, cell, query in found:
                            n = len(vid)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(vid), pa.array(np.full(n, t if p.depth else -1, np.int32)), pa.array(cell.astype(np.int64)), pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, query, np.int32))],
                                names=["vid", "tab", "cell", "dim", "query"],
                            )

    return run


WHOLE = -2  # the table in which every row passes


def passes(a: np.ndarray, b: np.ndarray, p: Plan, tables: list[int], rotations: int, seed: int) -> np.ndarray:
    """Which rows ``b`` the queries ``a`` are compared with."""
    ua, ub, excess = directions(a), directions(b), p.excess(log_norms(b)).astype(np.float32)
    out = np.zeros((len(a), len(b)), bool)
    for t in tables:
        score = np.zeros((len(a), len(b)), np.float32)
        for number in range(t * rotations, (t + 1) * rotations):
            score += np.take(signed(ua, p.width, number, seed), signed(ub, p.width, number, seed).argmax(axis=1), axis=1)
        out |= score * excess >= p.bound - 1e-6
        if p.groups[-1] == GROUPS - 1:
            out |= (p.group(log_norms(b)) == GROUPS - 1)[None, :]
    return out


def _best(plans: dict[int, Plan], tables: int, rotations: int, k: int, seed: int):
    """The k best rows of each block for each of its queries, ties by id."""

    def run(batches):
        out: list[tuple] = []
        held = 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["qid", "vid", "score"])

        for (t, _, d, _, _), rows in runs(batches, ["tab", "cell", "dim", "hc", "qc"]):
            rows = rows.combine_chunks()
            query = rows.column("query").to_numpy() == 1
            if query.all() or not query.any():
                continue
            ids = rows.column("vid").to_numpy()
            x = np.asarray(rows.column("vector").combine_chunks().flatten(), np.float64).reshape(len(rows), d)
            a, b, qid, vid = x[query], x[~query], ids[query], ids[~query]
            for at in range(0, len(a), 256):
                some = a[at : at + 256]
                if t == WHOLE:
                    rough = some @ b.T
                    # all that may be among the k best, however the product was rounded
                    low = np.partition(rough, max(len(b) - k, 0), axis=1)[:, max(len(b) - k, 0)]
                    i, j = np.nonzero(rough >= (low - 1e-9 * (np.abs(low) + np.linalg.norm(some, axis=1) * np.linalg.norm(b, axis=1).max()))[:, None])
                else:
                    i, j = np.nonzero(passes(some, b, plans[d], list(range(tables)) if t < 0 else [int(t)], rotations, seed))
                exact = np.concatenate([np.zeros(0), *((some[i[c : c + 100_000]] * b[j[c : c + 100_000]]).sum(axis=1) for c in range(0, len(i), 100_000))])
                place = np.lexsort((vid[j], -exact, i))
                first = np.searchsorted(i, np.arange(len(some)))  # i ascends
                place = place[np.arange(len(i)) - first[i] < k]
                out.append((qid[at : at + 256][i[place]], vid[j[place]], exact[place]))
                held += len(place)
                if held > 100_000:
                    yield flush()
                    out, held = [], 0
        if out:
            yield flush()

    return run


def _meet(kept: Kept, reps: DataFrame, cells: DataFrame, best, block: int) -> tuple[DataFrame, DataFrame]:
    """(qid, vid, score): the best rows of each block of a cell for each query in it; and the table of cells that it reads."""
    sizes = kept.put(cells.groupBy("tab", "cell", "dim").agg(F.sum(1 - F.col("query")).alias("rows"), F.sum("query").alias("queries")).where("rows > 0 and queries > 0"), "sizes")
    cut = lambda n, size: F.ceil(F.col(n) / F.lit(size)).cast("int")
    own = lambda n: F.pmod(F.xxhash64("vid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    placed = cells.join(sizes, ["tab", "cell", "dim"]).withColumn("nh", cut("rows", block)).withColumn("nq", cut("queries", block))
    blocks = placed.where("query = 0").withColumn("hc", own("nh")).withColumn("qc", every("nq")).unionByName(
        placed.where("query = 1").withColumn("qc", own("nq")).withColumn("hc", every("nh")))
    keys = ["tab", "cell", "dim", "hc", "qc"]
    units = blocks.select(*keys, "query", "vid").join(reps.select("vid", "vector"), "vid").repartition(*keys).sortWithinPartitions(*keys)
    return units.mapInArrow(best, "qid long, vid long, score double"), sizes


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    tables: int = 6, rotations: int = 6, slack: float = 0.3, block: int = 4096, depth: int | None = None, seed: int = 7,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with ``is_query`` the k rows of largest inner product, itself left out.

    A lower ``slack`` raises recall and work; the default reaches a recall over 0.9 on directions without any order, the hardest case (README). ``depth`` fixes
    how many rotations are the key of a cell. Every query gets k rows where there are so many.
    Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
    with a null id; only vectors of equal length meet; norms of any size are scaled first, so only inner products over the range of doubles are infinite; of rows that
    repeat an id each counts as a candidate, but the query's own id never does; ties go to the smaller id, however many there are; an empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    kept = Kept(spark)
    base = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    used = keyed(base.where(F.col("id").isNotNull() & usable(F.col("vector"))), "vector")
    groups = used.groupBy("k1", "k2").agg(F.min("id").alias("vid"), F.max("asks").alias("asks"), F.first("vector").alias("vector"))
    reps = kept.put(groups, "vectors")
    place = F.row_number().over(W.partitionBy("k1", "k2").orderBy("id"))
    names = used.select("k1", "k2", "id").withColumn("n", place).where(F.col("n") <= k + 1)
    members = kept.put(names.join(reps.select("k1", "k2", "vid"), ["k1", "k2"]).select("vid", "id"), "members")
    askers = kept.put(used.where("asks").select("k1", "k2", F.col("id").alias("query_id")).distinct().join(reps.select("k1", "k2", "vid"), ["k1", "k2"]).select("query_id", F.col("vid").alias("qid")), "askers")
    told: dict[int, dict[int, int]] = {}
    for x in reps.select("vector").mapInArrow(_norms, "dim int, class int, n long").groupBy("dim", "class").agg(F.sum("n").alias("n")).collect():
        told.setdefault(x["dim"], {})[x["class"]] = x["n"]
    plans = {d: plan(d, n, k, rotations, slack, block, depth) for d, n in told.items()}
    cells = kept.put(reps.select("vid", "vector", "asks").mapInArrow(_cells(plans, tables, rotations, seed), CELLS), "cells", whole=True)
    nearest = _best(plans, tables, rotations, k + 1, seed)
    # A row met in several tables has the same score each time, so that dense_rank counts it once.
    near = F.dense_rank().over(W.partitionBy("qid").orderBy(F.desc("score"), "vid"))
    best = lambda found: found.withColumn("n", near).where(F.col("n") <= k + 1).select("qid", "vid", "score").distinct()
    first, sizes = _meet(kept, reps, cells, nearest, block)
    top = kept.put(best(first), "near")
    kept.drop(cells, sizes)
    dim = F.size("vector").alias("dim")
    enough = top.groupBy("qid").count().where(F.col("count") > k).select("qid")
    short = kept.put(askers.select("qid").distinct().join(enough, "qid", "left_anti").join(reps.select(F.col("vid").alias("qid"), dim), "qid"), "short")
    if not short.isEmpty():
        every = reps.select("vid", dim).join(short.select("dim").distinct(), "dim").select("vid", "dim", F.lit(0).alias("query"))
        every = every.unionByName(short.select(F.col("qid").alias("vid"), "dim", F.lit(1).alias("query")))
        all_rows = kept.put(every.select("vid", F.lit(WHOLE).alias("tab"), F.lit(0).cast("long").alias("cell"), "dim", "query"), "every")
        whole, sizes = _meet(kept, reps, all_rows, nearest, block)
        found = kept.put(best(top.unionByName(whole)), "near")
        kept.drop(top, all_rows, sizes)
        top = found
    kept.drop(short)
    spread = askers.join(top, "qid").join(members, "vid").where("id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return few_files(spread.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score"))
