"""Exact nearest neighbours by cosine distance, pruned by angles to pivots, and greedy selection of what is far enough from all selected before.

A collection is dealt to cells, each row to the pivot of the least angle. Angles obey the triangle inequality, so a cell whose rows lie
between the angles ``low`` and ``high`` from its pivot holds nothing nearer to a query than max(t - high, low - t), t being the query's angle to that pivot. A query
searches its own cell first; other cells are compared with it only if their bound is within the k-th distance found so far. A row is also no nearer to the pivot of
the query's cell than to its own, so it lies beyond the plane midway between the two: the query's angle to that plane is a second bound. Nothing is lost; how much is
saved depends on the data: clustered rows leave most cells out, isotropic ones of many dimensions hardly any.

Cells lie together in blocks, near ones in the same. A query goes once to each block that holds a cell in its reach, and what is out of its reach there is left out within the task; so
rows are moved as often as there are blocks, some 8, and not as there are cells.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.ranking import global_rank
from tessera.session import ensure_checkpoints
from tessera.tables import Tables

log = logging.getLogger(__name__)

#: A task compares one block of queries with one of the collection. A table is cut into about ``BLOCKS`` of them, of ``BLOCK`` rows at least, and of more once one would get over
#: ``LARGEST`` rows or ``COMPONENTS`` components of vectors. So what is moved grows with the rows while a task's memory is bounded.
BLOCK, BLOCKS, LARGEST, COMPONENTS = 4096, 8, 1 << 17, 1 << 23
#: Rows for each pivot of a collection, and the most pivots; they travel in the closures of tasks.
ROWS_PER_PIVOT, PIVOTS = 512, 1024
#: Angles are compared with so much room for rounding, which near 0 is the square root of a double's.
SLACK = 1e-6
#: Queries and rows that a task multiplies at once.
TILE_QUERIES, TILE_ROWS = 2048, 1024
#: Which cells a query meets: its own, all in reach but its own, or all in reach.
HOME, OTHERS, ALL = "home", "others", "all"


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The unit vectors of a list column without nulls and zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 1))
    told = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return told / np.linalg.norm(told, axis=1, keepdims=True)


def angle(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _usable(df: DataFrame, name: str = "id") -> DataFrame:
    return df.select(F.col("id").alias(name), "vector").where(F.exists("vector", lambda x: x != 0))


@dataclass
class Cells:
    """Pivots, and of each cell how many rows it has and between which angles from its pivot they lie. ``nearest``: no row is nearer to another cell's pivot."""

    pivots: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    nearest: bool = False

    def beyond(self, some: np.ndarray, x: np.ndarray, own: np.ndarray, cosines: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """(queries, ``some`` cells): the plane midway between the pivots of the query's cell and of the other is out of reach. Pivots that hardly differ have no sure plane."""
        named, at = np.unique(own, return_inverse=True)
        apart = np.sqrt(np.maximum(2.0 - 2.0 * self.pivots[named] @ self.pivots[some].T, 0.0))
        apart[apart < 1e-3] = np.inf
        sure = np.where(reach + SLACK < math.pi / 2, np.sin(np.minimum(reach + SLACK, math.pi / 2)), np.inf)
        return (x * self.pivots[own]).sum(axis=1)[:, None] - cosines > sure[:, None] * apart[at]

    def bounds(self, angles: np.ndarray) -> np.ndarray:
        """(queries, cells): nothing in the cell is at a lesser angle. Cells without rows are out of reach."""
        least = np.maximum(np.maximum(angles - self.high, self.low - angles), 0.0)
        return np.where(self.rows > 0, least, np.inf)

    def reach(self, angles: np.ndarray, k: int) -> np.ndarray:
        """For each query an angle within which k rows surely lie: cells counted up by the furthest that their rows can be."""
        far = np.where(self.rows > 0, angles + self.high, np.inf)
        order = np.argsort(far, axis=1)
        enough = np.cumsum(self.rows[order], axis=1) >= k
        at = enough.argmax(axis=1)
        found = far[np.arange(len(far)), order[np.arange(len(far)), at]]
        return np.where(enough.any(axis=1), np.minimum(found, math.pi), math.pi)


def choose_pivots(collection: DataFrame, rows: int, per: int = ROWS_PER_PIVOT, most: int = PIVOTS) -> np.ndarray:
    """Different directions of a sample by hash, one for each ``per`` rows and at most ``most``: a bounded sample for the driver."""
    count = min(most, max(1, rows // max(1, per)))
    told = collection.orderBy(F.xxhash64("id"), "id").limit(count).select("vector").toArrow()
    units = matrix(told.column("vector"))
    return in_order(np.unique(units, axis=0)) if len(units) else np.zeros((0, 1))


def in_order(points: np.ndarray) -> np.ndarray:
    """The rows so that near ones lie together: halved again and again along the axis of most spread."""
    if len(points) < 3:
        return points
    axis = points[:, points.var(axis=0).argmax()].argsort(kind="stable")
    half = len(points) // 2
    return np.concatenate([in_order(points[axis[:half]]), in_order(points[axis[half:]])])


def assign(df: DataFrame, pivots: np.ndarray, columns: str) -> DataFrame:
    """``df`` (id..., vector) with the nearest pivot (cell) and the angle to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = matrix(batch.column("vector")) @ pivots.T if batch.num_rows else np.zeros((0, 1))
            cell = near.argmax(axis=1)
            told = [pa.array(cell.astype(np.int32)), pa.array(angle(near[np.arange(len(near)), cell]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *told], names=[*batch.schema.names, "cell", "angle"])

    return df.mapInArrow(run, f"{columns}, cell int, angle double")


def summary(cells: DataFrame, pivots: np.ndarray) -> Cells:
    """Counted from the assigned rows, one row a cell."""
    n = len(pivots)
    out = Cells(pivots, np.zeros(n, np.int64), np.zeros(n), np.zeros(n), nearest=True)
    for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("a"), F.max("angle").alias("b")).collect():
        out.rows[r["cell"]], out.low[r["cell"]], out.high[r["cell"]] = r["n"], r["a"], r["b"]
    return out


class Blocks:
    """Small cells lie together in a block, a large one in several: of each cell its first block and how many it has."""

    def __init__(self, rows: np.ndarray, size: int):
        self.first, self.parts = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        last, held = -1, size
        for c in np.flatnonzero(rows):
            n = int(rows[c])
            if n > size:
                self.first[c], self.parts[c] = last + 1, -(-n // size)
                last, held = last + int(self.parts[c]), size
                continue
            if held + n > size:
                last, held = last + 1, 0
            self.first[c], self.parts[c], held = last, 1, held + n
        self.count = last + 1
        number = np.arange(self.count)
        self.of = ((number >= self.first[:, None]) & (number < (self.first + self.parts)[:, None])).astype(np.float32)

    def asked(self, told: np.ndarray) -> np.ndarray:
        """(queries, blocks) of (queries, cells)."""
        return told.astype(np.float32) @ self.of > 0


def block_rows(rows: int, dim: int | None) -> int:
    return BLOCK if dim is None else min(max(BLOCK, -(-rows // BLOCKS)), LARGEST, max(256, COMPONENTS // max(1, dim)))


def _mixed(ids: np.ndarray) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


def _met(cells: Cells, some: np.ndarray, x: np.ndarray, own: np.ndarray, reach: np.ndarray, which: str) -> np.ndarray:
    """(queries, cells): which of ``some`` cells the queries are compared with."""
    home = own[:, None] == some
    if which == HOME:
        return home & (cells.rows[some] > 0)
    part = Cells(cells.pivots[some], cells.rows[some], cells.low[some], cells.high[some])
    cosines = x @ part.pivots.T
    told = part.bounds(angle(cosines)) <= reach[:, None] + SLACK
    if cells.nearest:
        told &= ~cells.beyond(some, x, own, cosines, reach)
    return told & ~home if which == OTHERS else told


def _of_queries(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return batch.column("query_id").to_numpy(), matrix(batch.column("vector")), batch.column("cell").to_numpy(), batch.column("reach").to_numpy()


def _meet(queries: DataFrame, read: Callable[[list[int]], DataFrame], cells: Cells, block: int | None, compare: Callable, shape: str, which: str) -> DataFrame:
    """``compare`` of each block of queries (query_id, vector, cell, reach) with each block of cells (id, vector, cell) that they meet. Queries of a block and cells larger than one are
    cut by hash, so one cell of any size is many tasks."""
    spark = queries.sparkSession
    dim = None if len(cells.pivots) == 1 else cells.pivots.shape[1]
    blocks = Blocks(cells.rows, block or block_rows(int(cells.rows.sum()), dim))
    every = np.arange(len(cells.rows))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_cell, by_block, n = np.zeros(len(every), np.int64), np.zeros(blocks.count, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                _, x, own, reach = _of_queries(batch.slice(at, 512))
                told = _met(cells, every, x, own, reach, which)
                by_cell, by_block, n = by_cell + told.sum(axis=0), by_block + blocks.asked(told).sum(axis=0), n + len(own)
        n = np.concatenate([by_cell, by_block, [n]])
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["at", "n"])

    queries = queries.select("query_id", "vector", "cell", "reach")
    n = np.zeros(len(every) + blocks.count + 1, np.int64)
    for r in queries.mapInArrow(counts, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # a number for each cell and block
        n[r["at"]] = r["n"]
    asked, asking = n[: len(every)], n[len(every) : -1]
    parts = -(-asking // (block or block_rows(int(n[-1]), dim)))
    held = blocks.of.T @ (cells.rows / np.maximum(blocks.parts, 1))
    log.info("compares %d pairs, moves %d queries and %d rows", int(asked @ cells.rows), int(asking.sum()), int(held @ parts))

    def spread_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                ids, x, own, reach = _of_queries(some)
                i, j = np.nonzero(blocks.asked(_met(cells, every, x, own, reach, which)))
                yield from _repeated(some, i, j, _mixed(ids)[i] % np.maximum(parts[j], 1))

    def spread_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                cell = some.column("cell").to_numpy()
                where = blocks.first[cell] + _mixed(some.column("id").to_numpy()) % np.maximum(blocks.parts[cell], 1)
                times = np.where(asked[cell] > 0, parts[where], 0)
                i = np.repeat(np.arange(len(cell)), times)
                yield from _repeated(some, i, where[i], np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, x, own, reach = _of_queries(a)
        b = b.sort_by([("cell", "ascending"), ("id", "ascending")])
        y, ib, cell = matrix(b.column("vector")), b.column("id").to_numpy(), b.column("cell").to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]])) if len(cell) else np.zeros(0, np.int64)
        some = cell[cut[:-1]]

        def tiles(left: np.ndarray) -> Iterator[tuple[np.ndarray, slice]]:
            """Queries, of those that are ``left``, with rows of a cell that they meet."""
            for at in range(0, len(x) if len(y) else 0, TILE_QUERIES):
                part = slice(at, at + TILE_QUERIES)
                told = _met(cells, some, x[part], own[part], reach[part], which)
                for c, (low, high) in enumerate(zip(cut, cut[1:])):
                    for first in range(low, high, TILE_ROWS):
                        rows = at + np.flatnonzero(told[:, c] & left[part])
                        if len(rows):
                            yield rows, slice(first, min(first + TILE_ROWS, high))

        return compare(x, y, ids, ib, reach, tiles)

    kind = lambda df: df.schema["vector"].dataType.simpleString()
    q = queries.mapInArrow(spread_queries, f"query_id long, vector {kind(queries)}, cell int, reach double, block int, part int")
    c = read(np.flatnonzero(asked).tolist()).select("id", "vector", "cell")
    c = c.mapInArrow(spread_rows, f"id long, vector {kind(c)}, cell int, block int, part int")
    return q.groupBy("block", "part").cogroup(c.groupBy("block", "part")).applyInArrow(meet, shape)


def _repeated(rows: pa.RecordBatch, i: np.ndarray, block: np.ndarray, part: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(i), 4096):
        told = rows.take(pa.array(i[k : k + 4096]))
        own = [pa.array(c[k : k + 4096].astype(np.int32)) for c in (block, part)]
        yield pa.RecordBatch.from_arrays([*told.columns, *own], names=[*told.schema.names, "block", "part"])


def _room(x: np.ndarray) -> float:
    """By how much a product of unit vectors in single precision can be off, twice."""
    return (x.shape[1] + 8) * 1.2e-7


def _exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of pairs in double precision, the same wherever a pair meets."""
    return 1.0 - np.concatenate([np.zeros(0), *((x[i[k : k + 65536]] * y[j[k : k + 65536]]).sum(axis=1) for k in range(0, len(i), 65536))])


def _first_copies(y: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Which rows have one of the ``most`` smallest ids of their vector."""
    y = np.ascontiguousarray(y)
    _, group = np.unique(y.view(np.dtype((np.void, y.shape[1] * 8))).ravel(), return_inverse=True)
    order = np.lexsort((ids, group))
    g, own = group[order], ids[order]
    starts = np.concatenate([[True], g[1:] != g[:-1]])
    number = np.cumsum(np.concatenate([[True], (g[1:] != g[:-1]) | (own[1:] != own[:-1])]))
    keep = np.zeros(len(y), bool)
    keep[order] = number - np.maximum.accumulate(np.where(starts, number, 0)) < most
    return keep


def _best(k: int, skip_same_id: bool) -> Callable[..., pa.Table]:
    """The k nearest rows of each query. Products in single precision tell which pairs can be among them, with room for their rounding; those are computed in double precision. With
    ties by id, of equal vectors only the smallest ids count."""

    def best(x: np.ndarray, y: np.ndarray, ia: np.ndarray, ib: np.ndarray, reach: np.ndarray, tiles: Callable) -> pa.Table:
        near, who = np.full((len(x), k), np.inf), np.full((len(x), k), np.iinfo(np.int64).max)
        bound = 1.0 - np.cos(np.minimum(reach + SLACK, math.pi))
        if len(x) and len(y):
            few, room, x4, y4 = _first_copies(y, ib, k + 1), _room(x), x.astype(np.float32), y.astype(np.float32)
            for rows, place in tiles(np.ones(len(x), bool)):
                own = np.arange(place.start, place.stop)[few[place]]
                if not len(own):
                    continue
                rough = x4[rows] @ y4[own].T
                least = 1.0 - bound[rows] - room
                some = rough.max(axis=1) >= least  # most queries have nothing to gain here
                if not some.all():
                    rows, rough, least = rows[some], rough[some], least[some]
                if not len(rows):
                    continue
                hit = rough >= least[:, None]
                if len(own) > k and np.count_nonzero(hit) > 8 * k * len(rows):
                    if skip_same_id:
                        rough[ia[rows][:, None] == ib[own]] = -np.inf
                    hit &= rough >= (np.partition(rough, len(own) - k, axis=1)[:, len(own) - k] - 2 * room)[:, None]
                i, j = np.nonzero(hit)
                i, j = rows[i], own[j]
                if skip_same_id:
                    i, j = i[ia[i] != ib[j]], j[ia[i] != ib[j]]
                d = _exact(x, y, i, j)
                sub = np.unique(i)
                at, told, names = np.concatenate([i, np.repeat(sub, k)]), np.concatenate([d, near[sub].ravel()]), np.concatenate([ib[j], who[sub].ravel()])
                order = np.lexsort((names, told, at))
                at = at[order]
                order = order[np.arange(len(at)) - np.searchsorted(at, at) < k]
                near[sub], who[sub] = told[order].reshape(-1, k), names[order].reshape(-1, k)
                bound[sub] = np.minimum(bound[sub], near[sub, -1])
        i, j = np.nonzero(np.isfinite(near))
        return pa.table([pa.array(ia[i].astype(np.int64)), pa.array(who[i, j]), pa.array(near[i, j])], names=["query_id", "id", "distance"])

    return best


def _dealt(queries: DataFrame, collection: DataFrame, pivots: np.ndarray | None, tables: Tables) -> tuple[DataFrame, DataFrame, Cells]:
    own = _usable(collection)
    if pivots is None:
        n = own.count()
        if 0 < n <= BLOCK:  # one block needs no cells
            q = _usable(queries, "query_id").withColumn("cell", F.lit(0))
            c = own.select(F.col("id").alias("id"), F.col("vector").alias("vector"), F.lit(0).alias("cell"))  # columns of their own, as both may be one table
            return q, c, Cells(np.zeros((1, 1)), np.array([n]), np.zeros(1), np.full(1, math.pi))
        pivots = choose_pivots(own, n)
    kind = lambda df: df.schema["vector"].dataType.simpleString()
    if not len(pivots):
        return queries, collection, Cells(pivots, np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    c = tables.put(assign(own, pivots, f"id long, vector {kind(own)}"))
    q = assign(_usable(queries, "query_id"), pivots, f"query_id long, vector {kind(queries)}")
    return q, c, summary(c, pivots)


def nearest(queries: DataFrame, collection: DataFrame, k: int, block: int | None = None, skip_same_id: bool = False, pivots: np.ndarray | None = None) -> DataFrame:
    """(query_id, rank, id, distance): the k rows of ``collection`` least far from each row of ``queries``, ties by id.

    Both have (id, vector). The k-th distance in a query's own cell, or the one that counts of cells already promise, bounds which other cells it is paired with. Blocks of queries
    meet blocks of a cell, one task each, by a matrix product in double precision; a block gives only its k best. Vectors that are null or zero have no distance and
    take no part.
    """
    tables = Tables(queries.sparkSession)
    q, c, cells = _dealt(queries, collection, pivots, tables)
    if not len(cells.pivots):
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, id long, distance double")
    return search_cells(q, lambda _: c, cells, k, block, skip_same_id, tables)


def search_cells(q: DataFrame, read: Callable[[list[int]], DataFrame], cells: Cells, k: int, block: int | None, skip_same_id: bool, tables: Tables) -> DataFrame:
    """``nearest`` of assigned queries; ``read`` gives the rows of the cells that are in reach, and may give more."""
    shape = "query_id long, id long, distance double"
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    compare = _best(k, skip_same_id)
    anywhere = lambda df: df.withColumn("reach", F.lit(math.pi))
    if len(cells.pivots) == 1:
        found = _meet(anywhere(q), read, cells, block, compare, shape, HOME)
    else:
        q = tables.put(q)
        found = tables.put(_meet(anywhere(q), read, cells, block, compare, shape, HOME))
        kth = found.withColumn("r", rank).where(F.col("r") == k).select("query_id", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.col("distance")))).alias("kth"))
        wanted = k + int(skip_same_id)

        def promised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                reach = cells.reach(angle(matrix(batch.column("vector")) @ cells.pivots.T), wanted)
                kth_ = batch.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)
                told = np.fmin(reach, kth_)
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("query_id", "vector", "cell")), pa.array(told)], names=["query_id", "vector", "cell", "reach"])

        kind = q.schema["vector"].dataType.simpleString()
        bounded = q.join(kth, "query_id", "left").select("query_id", "vector", "cell", "kth").mapInArrow(promised, f"query_id long, vector {kind}, cell int, reach double")
        found = found.unionByName(_meet(tables.put(bounded), read, cells, block, compare, shape, OTHERS))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def self_distance(items: DataFrame, text: str = "text", block: int | None = None) -> DataFrame:
    """(id, distance) to the nearest other row: where the nearest row has the query's own text the second one counts, so an exact
    copy has 0 (O54). ``items`` has (id, vector, text)."""
    two = nearest(items, items, 2, block)
    names = items.select("id", F.trim(text).alias("t"))
    pairs = two.join(names, "id").join(names.select(F.col("id").alias("query_id"), F.col("t").alias("qt")), "query_id")
    one = lambda r: F.max(F.when(F.col("rank") == r, F.col("distance")))
    same = F.max(F.when((F.col("rank") == 1) & (F.col("t") == F.col("qt")), True))
    return pairs.groupBy(F.col("query_id").alias("id")).agg(F.when(same, one(2)).otherwise(one(1)).alias("distance"))


def _within(queries: DataFrame, collection: DataFrame, least: float, block: int | None, compare: Callable, shape: str, pivots: np.ndarray | None) -> DataFrame:
    """``compare`` of each block of queries with the blocks of the cells that may hold rows not further than ``least``."""
    tables = Tables(queries.sparkSession)
    q, c, cells = _dealt(queries, collection, pivots, tables)
    if not len(cells.pivots):
        return queries.sparkSession.createDataFrame([], shape)
    return reach_cells(q, lambda _: c, cells, least, block, compare, shape, tables)


def reach_cells(q: DataFrame, read: Callable[[list[int]], DataFrame], cells: Cells, least: float, block: int | None, compare: Callable, shape: str, tables: Tables) -> DataFrame:
    reach = math.acos(max(-1.0, min(1.0, 1.0 - least)))
    if len(cells.pivots) > 1:
        q = tables.put(q)
    return _meet(q.withColumn("reach", F.lit(reach)), read, cells, block, compare, shape, HOME if len(cells.pivots) == 1 else ALL)


def _close(x: np.ndarray, y: np.ndarray, x4: np.ndarray, y4: np.ndarray, rows: np.ndarray, place: slice, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a tile that are not further than ``least``."""
    i, j = np.nonzero(x4[rows] @ y4[place].T >= 1.0 - least - _room(x))
    i, j = rows[i], place.start + j
    near = _exact(x, y, i, j) <= least
    return i[near], j[near]


def near_pairs(items: DataFrame, least: float, block: int | None = None, pivots: np.ndarray | None = None) -> DataFrame:
    """(a, b) of different rows not further than ``least`` from each other, both ways."""

    def near(x: np.ndarray, y: np.ndarray, ia: np.ndarray, ib: np.ndarray, reach: np.ndarray, tiles: Callable) -> pa.Table:
        out, x4, y4 = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], x.astype(np.float32), y.astype(np.float32)
        for rows, place in tiles(np.ones(len(x), bool)):
            i, j = _close(x, y, x4, y4, rows, place, least)
            out.append((ia[i], ib[j]))
        one, two = (np.concatenate(c) for c in zip(*out))
        return pa.table([pa.array(one[one != two]), pa.array(two[one != two])], names=["a", "b"])

    return _within(items, items, least, block, near, "a long, b long", pivots)


def any_within(least: float) -> Callable[..., pa.Table]:
    def near(x: np.ndarray, y: np.ndarray, ia: np.ndarray, ib: np.ndarray, reach: np.ndarray, tiles: Callable) -> pa.Table:
        left, x4, y4 = np.ones(len(x), bool), x.astype(np.float32), y.astype(np.float32)
        for rows, place in tiles(left):
            left[_close(x, y, x4, y4, rows, place, least)[0]] = False
        return pa.table([pa.array(ia[~left].astype(np.int64))], names=["id"])

    return near


def near_ids(queries: DataFrame, collection: DataFrame, least: float, block: int | None = None, pivots: np.ndarray | None = None) -> DataFrame:
    """(id) of the queries that have a row of ``collection`` not further than ``least``: a block tells an id at most once."""
    return _within(queries, collection, least, block, any_within(least), "id long", pivots).distinct()


class Greedy:
    """One pass in order of preference (O63). A row is accepted while its label's quota lasts if it is further than ``least`` from every vector accepted
    before, or brings a new tag; a row refused for its quota does not block later ones. ``least`` 0 asks for no distance.
    """

    def __init__(self, least: float, size: int | None = None, quotas: dict[str, float] | None = None, tags: bool = False, seen: set[str] | None = None, base: np.ndarray | None = None):
        self.least, self.size, self.tags = least, size, tags
        self.left, self.seen = dict(quotas or {}), set(seen or ())
        self.kept = np.zeros((0, 0)) if base is None else np.asarray(base, np.float64)
        self.used, self.accepted = len(self.kept), 0

    def full(self) -> bool:
        return self.size is not None and self.accepted >= self.size

    def take(self, vector, label: str | None = None, own: list[str] | None = None, near: bool = False) -> bool:
        """Whether the next row is accepted; ``near`` tells that something outside of this pass is near it."""
        if self.full() or (label in self.left and self.left[label] <= 0):
            return False
        unit = np.asarray(vector, np.float64)
        unit = unit / max(np.linalg.norm(unit), 1e-300)
        new = set() if own is None or not self.tags else set(own) - self.seen
        far = self.least <= 0 or not (near or (self.used and float(1 - (self.kept[: self.used] @ unit).max()) <= self.least))
        if not (far or new):
            return False
        if self.used == len(self.kept):
            more = np.zeros((max(64, 2 * self.used), len(unit)))
            more[: self.used] = self.kept[: self.used] if self.used else 0
            self.kept = more
        self.kept[self.used] = unit
        self.used += 1
        self.accepted += 1
        self.seen |= new
        if label in self.left:
            self.left[label] -= 1
        return True


def greedy_pass(items: DataFrame, least: float, size: int | None = None, quotas: dict[str, float] | None = None, tags: bool = False, seen: set[str] | None = None) -> DataFrame:
    """The rows that the pass accepts, from (id, rank, vector) and where there are such columns label, tags and near.

    The plain form for small tables: one task streams the rows in order of rank and keeps the accepted vectors. ``greedy_windows`` gives the same rows of
    large ones, ``greedy_select`` where there are no quotas and tags.
    """
    names = items.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = Greedy(least, size, quotas, tags, seen)
        for rows in batches:
            own = [rows[c] if c in names else [None] * len(rows) for c in ("label", "tags", "near")]
            yield rows[[state.take(v, label, told, bool(near)) for v, label, told, near in zip(rows["vector"], *own)]]
            if state.full():
                return

    return items.coalesce(1).sortWithinPartitions("rank", "id").mapInPandas(run, items.schema)


def _pass_of_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows in order with the ids of their near rows before them those that a pass refuses."""
    refused: set[int] = set()
    for rows in batches:
        out = []
        for own, before in zip(rows["id"], rows["before"]):
            if before is not None and not refused.issuperset(before):
                refused.add(own)
                out.append(own)
        yield pd.DataFrame({"id": out}, dtype="int64")


def _refused(edges: DataFrame, ranks: DataFrame, small: int) -> list[DataFrame]:
    """(id) of the rows that a pass refuses, by edges (a, b) from rows to later ones. In each round the rows without an open row before them are accepted and those
    near them refused; only edges between rows that are still open go on to the next round, written once. When at most ``small`` of them are left, which is counted, one task goes
    through their rows in order."""
    refused: list[DataFrame] = []
    while (left := edges.count()) > small:
        first = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = edges.join(first, "a", "left_semi").select(F.col("b").alias("id")).distinct().checkpoint()
        refused.append(gone)
        edges = edges.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b").checkpoint()
    if left:
        before = edges.groupBy(F.col("b").alias("id")).agg(F.collect_list("a").alias("before"))
        rows = ranks.join(before, "id").coalesce(1).sortWithinPartitions("rank", "id").select("id", "before")
        refused.append(rows.mapInPandas(_pass_of_pairs, "id long"))
    return refused


def _edges(pairs: DataFrame, ranks: DataFrame) -> DataFrame:
    up = pairs.join(ranks.select(F.col("id").alias("a"), F.col("rank").alias("ra")), "a").join(ranks.select(F.col("id").alias("b"), F.col("rank").alias("rb")), "b")
    return up.where("ra < rb").select("a", "b").distinct().checkpoint()


#: The first window of a selection, and of how many near pairs, by a sample of so many rows, a window is halved.
WINDOW, PAIRS, SAMPLE = 8192, 1 << 22, 256


def _many_pairs(rows: DataFrame, count: int, least: float, most: int) -> bool:
    """Whether ``count`` rows have more than about ``most`` near pairs, told from a sample."""
    if count * count <= most:
        return False
    some = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)

    def number(x: np.ndarray, y: np.ndarray, ia: np.ndarray, ib: np.ndarray, reach: np.ndarray, tiles: Callable) -> pa.Table:
        n, x4, y4 = 0, x.astype(np.float32), y.astype(np.float32)
        for told, place in tiles(np.ones(len(x), bool)):
            n += int(np.count_nonzero(x4[told] @ y4[place].T >= 1.0 - least))
        return pa.table([pa.array([n], pa.int64())], names=["n"])

    found = _within(some, rows, least, None, number, "n long", None).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return found * count > most * min(count, SAMPLE)


def greedy_select(items: DataFrame, least: float, pairs: DataFrame | None = None, small: int = 200_000, window: int = WINDOW, most: int = PAIRS) -> DataFrame:
    """The rows (id, rank, vector) that a pass in order of rank accepts, each further than ``least`` from all accepted before (O63 without
    tags and quotas).

    That is the lexicographically first maximal independent set of the graph of near pairs, which is decided in parallel rounds (``_refused``). ``pairs`` (a, b: ids of near rows, both
    ways) may come from any similarity join. By default rows are taken in windows in order of (rank, id), each twice as long as the one before: those near to a row accepted
    earlier go first, so that only pairs among the rest of the window are ever written. The more rows there are before a window, the fewer are left, so all
    those pairs grow no faster than the rows. Where a window's rest has more than about ``most`` of them, it is halved.
    """
    ensure_checkpoints(items.sparkSession)
    if pairs is not None:
        ranks = items.select("id", "rank")
        for gone in _refused(_edges(pairs, ranks), ranks, small):
            items = items.join(gone, "id", "left_anti")
        return items
    tables = Tables(items.sparkSession)
    usable = items.select("id", "rank", "vector").where(F.exists("vector", lambda x: x != 0))
    ranked = tables.put(global_rank(usable, [F.asc("rank"), F.asc("id")], "_pos").select("id", F.col("_pos").alias("rank"), "vector"))
    last, at = ranked.agg(F.max("rank")).first()[0] or 0, 0
    refused: list[DataFrame] = []
    kept: DataFrame | None = None
    while at < last:
        size = min(window, last - at)
        rows = ranked.where((F.col("rank") > at) & (F.col("rank") <= at + size))
        if kept is not None:
            gone = tables.put(near_ids(rows.select("id", "vector"), kept, least))
            refused.append(gone)
            rows = tables.put(rows.join(gone, "id", "left_anti"))
        whole = size
        while size > 1 and _many_pairs(rows, rows.count(), least, most):
            size = -(-size // 2)
            rows = rows.where(F.col("rank") <= at + size)
        gone = None
        for told in _refused(_edges(near_pairs(rows.select("id", "vector"), least), rows.select("id", "rank")), rows.select("id", "rank"), small):
            gone = told if gone is None else gone.unionByName(told)
        if gone is not None:
            gone = tables.put(gone)
            refused.append(gone)
            rows = rows.join(gone, "id", "left_anti")
        at += size
        if at < last:
            new = tables.put(rows.select("id", "vector"))
            kept = new if kept is None else kept.unionByName(new)
            window = 2 * size if size == whole else size
    if refused:
        gone = refused[0]
        for told in refused[1:]:
            gone = gone.unionByName(told)
        items = items.join(gone, "id", "left_anti")
    return items


def _replay(left: dict[str, float], tags: bool) -> Callable:
    """Goes through the rows of one window in order: (id, label, near, before: near rows of the window before it, new: its tags that nothing before the window has)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, accepted, seen = dict(left), set(), set()
        for rows in batches:
            keep = []
            for own, label, near, before, new in zip(rows["id"], rows["label"], rows["near"], rows["before"], rows["new"]):
                fresh = tags and new is not None and not seen.issuperset(new)
                far = not near and (before is None or accepted.isdisjoint(before))
                ok = not (label in counts and counts[label] <= 0) and (far or fresh)
                keep.append(ok)
                if ok:
                    accepted.add(own)
                    if tags and new is not None:
                        seen.update(new)
                    if label in counts:
                        counts[label] -= 1
            yield rows[keep][["id"]]

    return run


def greedy_windows(
    items: DataFrame, least: float, size: int | None = None, quotas: dict[str, float] | None = None, tags: bool = False, seen: DataFrame | None = None, window: int = 8192,
) -> DataFrame:
    """The rows that a pass in order of (rank, id) accepts, from (id, rank, vector) and where there are such columns label, tags and near.

    A row is accepted while its label's quota lasts if it is further than ``least`` from every row accepted before (and ``near`` is not set), or brings a tag that none of those has and
    ``seen`` (tag) does not hold; a row refused for its quota does not block later ones. ``least`` 0 asks for no distance; ``size`` ends the pass.

    Rows are taken in windows of ``window`` ranks. Within a window everything that needs vectors or tags is found in parallel: which rows are near to one
    accepted in earlier windows, which are near to each other, which tags are new. A row that shares nothing with another row of its window and has no quota is
    decided by that alone; the others, ids without vectors and at most a window of them, are replayed in order by one task. Accepted vectors, their tags and the quotas
    left are small tables that the next window reads. A null label has no quota, null tags are none, rows whose vector is null or zero have no distance and are far.
    """
    spark = items.sparkSession
    tables = Tables(spark)
    quotas = dict(quotas or {})
    names = items.columns
    null = lambda kind: F.lit(None).cast(kind)
    label = F.col("label").cast("string") if "label" in names else null("string")
    own_tags = F.array_distinct(F.filter("tags", lambda t: t.isNotNull())) if tags and "tags" in names else null("array<string>")
    near = F.coalesce("near", F.lit(False)) if "near" in names else F.lit(False)
    ranked = global_rank(items, [F.asc("rank"), F.asc("id")], "_pos")
    ranked = tables.put(ranked.withColumn("_window", F.floor((F.col("_pos") - 1) / window).cast("int")), "_window")
    last = ranked.agg(F.max("_window")).first()[0]
    known = (seen if seen is not None else spark.createDataFrame([], "tag string")).select(F.col("tag").cast("string").alias("tag"))
    kept: list[DataFrame] = []
    accepted = 0
    for number in range(-1 if last is None else last + 1):
        if size is not None and accepted >= size:
            break
        rows = ranked.where(F.col("_window") == number)
        base = rows.select("id", "_pos", label.alias("label"), own_tags.alias("tags"), near.alias("near"))
        if quotas:  # labels whose quota is used up are out whatever comes
            base = base.where(F.col("label").isNull() | ~F.col("label").isin([q for q, n in quotas.items() if n <= 0] or [""]))
        vectors = rows.select("id", "vector").join(base.select("id"), "id", "left_semi")
        told = base
        if least > 0:
            pairs = near_pairs(vectors, least)
            pos = base.select("id", "_pos")
            up = pairs.join(pos.select(F.col("id").alias("a"), F.col("_pos").alias("pa")), "a").join(pos.select(F.col("id").alias("b"), F.col("_pos").alias("pb")), "b").where("pa < pb")
            up = tables.put(up.select("a", "b").distinct())
            before = up.groupBy(F.col("b").alias("id")).agg(F.collect_list("a").alias("before"))
            touched = up.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("touched", F.lit(True))
            told = told.join(before, "id", "left").join(touched, "id", "left")
            if kept:
                old = kept[0].select("id", "vector")
                for k in kept[1:]:
                    old = old.unionByName(k.select("id", "vector"))
                told = told.join(near_ids(vectors, old, least).withColumn("hit", F.lit(True)), "id", "left")
                told = told.withColumn("near", F.col("near") | F.coalesce("hit", F.lit(False))).drop("hit")
        else:
            told = told.withColumns({"before": null("array<long>"), "touched": null("boolean"), "near": F.lit(False)})
        if tags:
            new = base.select("id", F.explode("tags").alias("tag")).join(known, "tag", "left_anti")
            new = tables.put(new)
            shared = new.groupBy("tag").agg(F.count("*").alias("n")).where("n > 1")
            lists = new.join(shared, "tag", "left").groupBy("id").agg(F.collect_list("tag").alias("new"), F.max(F.col("n").isNotNull()).alias("shares"))
            told = told.join(lists, "id", "left")
        else:
            told = told.withColumns({"new": null("array<string>"), "shares": F.lit(False)})
        bound = F.col("label").isin(list(quotas)) if quotas else F.lit(False)
        told = told.withColumn("open", F.coalesce("touched", F.lit(False)) | F.coalesce("shares", F.lit(False)) | F.coalesce(bound, F.lit(False)))
        told = tables.put(told.select("id", "_pos", "label", "near", "before", "new", "open"))
        alone = told.where(~F.col("open") & (~F.col("near") | F.coalesce(F.size("new") > 0, F.lit(False)))).select("id")
        compact = told.where("open").coalesce(1).sortWithinPartitions("_pos").select("id", "label", "near", "before", "new")
        chosen = alone.unionByName(compact.mapInPandas(_replay(quotas, tags), "id long"))
        out = rows.join(chosen, "id", "left_semi")
        if size is not None:
            out = out.orderBy("_pos").limit(size - accepted)
        out = tables.put(out.select("_pos", *names))
        kept.append(out)
        accepted += out.count()
        if quotas:
            for r in out.where(F.col("label").cast("string").isin(list(quotas))).groupBy(F.col("label").cast("string").alias("label")).count().collect():
                quotas[r["label"]] -= r["count"]
        if tags:
            known = tables.put(known.unionByName(out.select(F.explode(own_tags).alias("tag"))).distinct())
    if not kept:
        return items.limit(0)
    found = kept[0]
    for k in kept[1:]:
        found = found.unionByName(k)
    return found.select(*names)
