"""A growing table of (id, document, embedding) (O130) and batches of requests (O131)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera import tables as T
from tessera.operators import neighbours as N
from tessera.operators.ranking import global_rank


def numbered(df: DataFrame, order: str, first: int = 0) -> DataFrame:
    """Ids as text, counted on from ``first`` in the order of a key."""
    return global_rank(df, [F.col(order)], "_r").withColumn("id", (F.col("_r") - 1 + first).cast("string")).drop("_r")


def append(collection: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """The collection with new rows whose ids go on from its count."""
    return collection.unionByName(numbered(new, order, collection.count()).select(*collection.columns))


def batch_of(ordinal: Column, size: int) -> Column:
    return F.floor(ordinal / F.lit(size)).cast("long")


@dataclass
class Cell:
    """What a version knows of one cell: its pivot, rows, the angles between which they lie, and the batches that hold them."""

    pivot: list[float]
    rows: int = 0
    low: float = np.inf
    high: float = 0.0
    batches: list[int] = field(default_factory=list)


class VectorCollection:
    """A collection of (id, document, vector) on shared storage that grows by batches and is searched without reading all of it.

    Rows lie in cells around pivots, one folder for each batch and cell. An append writes only its own rows, to the cells they fall in; a cell that would get over ``most`` rows,
    or lies in over ``files`` batches, is read, parted around new pivots and written anew. A small table for each version names the cells, so a reader sees a whole batch or
    none, and a batch that is appended again under its number replaces what it wrote. Ids count on from the rows before, in order of ``order``. Rows whose vector is null or zero
    are numbered but cannot be found.
    """

    MANIFEST = "cell int, pivot array<double>, rows long, low double, high double, batches array<int>, total long"

    def __init__(self, spark: SparkSession, folder: str, most: int = 50_000, files: int = 16):
        self.spark, self.folder, self.most, self.files = spark, folder.rstrip("/"), most, files

    # versions

    def versions(self) -> list[int]:
        return sorted(int(v) for v in T.children(self.spark, f"{self.folder}/versions") if v.isdigit())

    def cells(self, before: int | None = None) -> tuple[dict[int, Cell], int]:
        """(cells, rows numbered so far) of the latest version, or of the latest before a number."""
        known = [v for v in self.versions() if before is None or v < before]
        if not known:
            return {}, 0
        rows = self.spark.read.schema(self.MANIFEST).parquet(f"{self.folder}/versions/{known[-1]}").collect()  # a row for each cell
        return {r["cell"]: Cell(r["pivot"], r["rows"], r["low"], r["high"], r["batches"]) for r in rows if r["cell"] >= 0}, max(r["total"] for r in rows)

    def _commit(self, number: int, cells: dict[int, Cell], total: int) -> None:
        rows = [(c, x.pivot, x.rows, float(x.low), float(x.high), x.batches, total) for c, x in cells.items()] + [(-1, [], 0, 0.0, 0.0, [], total)]
        draft = f"{self.folder}/drafts/{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, self.MANIFEST).coalesce(1).write.parquet(draft)
        for old in self.versions():
            if old >= number:
                T.remove(self.spark, f"{self.folder}/versions/{old}")
        T.make(self.spark, f"{self.folder}/versions")
        T.rename(self.spark, draft, f"{self.folder}/versions/{number}")

    # rows

    def rows(self, wanted: list[int] | None = None, before: int | None = None) -> DataFrame:
        """(id, document, vector, cell) of the cells asked for, of all by default."""
        cells, _ = self.cells(before)
        return self._read(cells, list(cells) if wanted is None else wanted)

    def _read(self, cells: dict[int, Cell], wanted: list[int]) -> DataFrame:
        shape = "id long, document string, vector array<double>, batch int, cell int"
        paths = [f"{self.folder}/rows/batch={b}/cell={c}" for c in wanted for b in cells[c].batches]
        if not paths:
            return self.spark.createDataFrame([], shape).drop("batch")
        return self.spark.read.schema(shape).option("basePath", f"{self.folder}/rows").parquet(*paths).drop("batch")

    def append(self, new: DataFrame, order: str, number: int | None = None) -> int:
        """Adds rows (document, vector and ``order``), under the next number or one that replaces this batch and all later ones; returns the number."""
        known = self.versions()
        number = (known[-1] + 1 if known else 0) if number is None else number
        cells, total = self.cells(before=number)
        tables = T.Tables(self.spark)
        ranked = global_rank(new.select(F.col(order).alias("_order"), F.col("document").cast("string").alias("document"), F.col("vector").cast("array<double>").alias("vector")), [F.col("_order")], "_r")
        ranked = tables.put(ranked.select((F.col("_r") - 1 + total).alias("id"), "document", "vector"))
        usable = ranked.where(F.exists("vector", lambda x: x != 0))
        count = ranked.count()
        if not cells:
            cells = {i: Cell(p.tolist()) for i, p in enumerate(N.choose_pivots(usable, count, max(1, self.most // 2)))}
        if cells:
            dealt = tables.put(self._assigned(usable, cells))
            added = {r["cell"]: r for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("a"), F.max("angle").alias("b")).collect()}
            parted = [c for c, r in added.items() if cells[c].rows + r["n"] > self.most or len(cells[c].batches) >= self.files]
            plain = dealt if not parted else dealt.where(~F.col("cell").isin(parted))
            for c in set(added) - set(parted):
                self._grow(cells[c], added[c], number)
            out = plain
            if parted:
                old = self._read(cells, parted).select("id", "document", "vector", "cell")
                split = tables.put(self._split(dealt.where(F.col("cell").isin(parted)).select("id", "document", "vector", "cell").unionByName(old), cells, tables))
                for c in parted:
                    del cells[c]
                for r in split.groupBy("cell", "pivot").agg(F.count("*").alias("n"), F.min("angle").alias("a"), F.max("angle").alias("b")).collect():
                    cells[r["cell"]] = Cell(r["pivot"])
                    self._grow(cells[r["cell"]], r, number)
                out = plain.unionByName(split.drop("pivot"))
            out.select("id", "document", "vector", "cell").repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.folder}/rows/batch={number}")
        self._commit(number, cells, total + count)
        tables.clear()
        return number

    @staticmethod
    def _grow(cell: Cell, r, number: int) -> None:
        cell.rows, cell.low, cell.high = cell.rows + r["n"], min(cell.low, r["a"]), max(cell.high, r["b"])
        cell.batches = [*cell.batches, number]

    def _assigned(self, rows: DataFrame, cells: dict[int, Cell]) -> DataFrame:
        """Rows with the cell of the nearest pivot, and the angle. Of cells around one pivot the last made gets the rows."""
        names = np.array(sorted(cells, reverse=True))
        told = N.assign(rows.select("id", "document", "vector"), np.array([cells[c].pivot for c in names]), "id long, document string, vector array<double>")
        return told.withColumn("cell", F.element_at(F.array(*(F.lit(int(c)) for c in names)), F.col("cell") + 1))

    def _split(self, rows: DataFrame, cells: dict[int, Cell], tables: T.Tables) -> DataFrame:
        """Rows of full cells with new cells, their pivots and angles: each old cell is parted around pivots of its own, half of ``most`` rows for each, and what still is too large, as
        many equal vectors are, by hash."""
        rows = tables.put(rows)
        sizes = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        many = max(-(-2 * n // self.most) for n in sizes.values())
        place = F.row_number().over(W.partitionBy("cell").orderBy(F.xxhash64("id"), "id"))
        sample = rows.select("id", "cell", "vector").withColumn("place", place).where(F.col("place") <= many).collect()
        pivots: dict[int, np.ndarray] = {}
        for c, n in sizes.items():
            own = np.array([r["vector"] for r in sample if r["cell"] == c and r["place"] <= -(-2 * n // self.most)], np.float64)
            pivots[c] = np.unique(own / np.linalg.norm(own, axis=1, keepdims=True), axis=0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit, cell = N.matrix(batch.column("vector")), batch.column("cell").to_numpy()
                nth, turn = np.zeros(len(cell), np.int32), np.zeros(len(cell))
                for c in np.unique(cell):
                    own = np.flatnonzero(cell == c)
                    near = unit[own] @ pivots[c].T
                    nth[own] = near.argmax(axis=1)
                    turn[own] = N.angle(near.max(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth), pa.array(turn)], names=[*batch.schema.names, "nth", "angle"])

        told = tables.put(rows.mapInArrow(run, "id long, document string, vector array<double>, cell int, nth int, angle double"))
        first = max(cells) + 1
        plan = []
        for r in told.groupBy("cell", "nth").agg(F.count("*").alias("n")).orderBy("cell", "nth").collect():
            parts = -(-r["n"] // self.most)
            plan.append((r["cell"], r["nth"], parts, first, pivots[r["cell"]][r["nth"]].tolist()))
            first += parts
        plan = self.spark.createDataFrame(plan, "cell int, nth int, parts int, first int, pivot array<double>")
        told = told.join(F.broadcast(plan), ["cell", "nth"])  # a row for each new pivot
        return told.select("id", "document", "vector", (F.col("first") + F.pmod(F.xxhash64("id"), "parts")).cast("int").alias("cell"), "angle", "pivot")

    # searches

    def _asked(self, queries: DataFrame, before: int | None) -> tuple[DataFrame, dict[int, Cell], N.Cells, list[int]] | None:
        cells, _ = self.cells(before)
        names = [c for c in sorted(cells) if cells[c].rows]
        if not names:
            return None
        own = N.Cells(np.array([cells[c].pivot for c in names]), *(np.array([getattr(cells[c], a) for c in names]) for a in ("rows", "low", "high")))
        kind = queries.schema["vector"].dataType.simpleString()
        some = queries.select(F.col("id").alias("query_id"), "vector").where(F.exists("vector", lambda x: x != 0))
        return N.assign(some, own.pivots, f"query_id long, vector {kind}"), cells, own, names

    def _reader(self, cells: dict[int, Cell], names: list[int]):
        place = F.create_map(*(F.lit(int(x)) for i, c in enumerate(names) for x in (c, i)))
        return lambda wanted: self._read(cells, [names[i] for i in wanted]).withColumn("cell", place[F.col("cell")])

    def nearest(self, queries: DataFrame, k: int, block: int | None = None, before: int | None = None) -> DataFrame:
        """(query_id, rank, id, distance) as ``neighbours.nearest``, reading only cells in reach."""
        asked = self._asked(queries, before)
        if asked is None:
            return self.spark.createDataFrame([], "query_id long, rank int, id long, distance double")
        q, cells, own, names = asked
        return N.search_cells(q, self._reader(cells, names), own, k, block, False, T.Tables(self.spark))

    def near_ids(self, queries: DataFrame, least: float, block: int | None = None, before: int | None = None) -> DataFrame:
        """(id) of the queries that have a row not further than ``least``."""
        asked = self._asked(queries, before)
        if asked is None:
            return self.spark.createDataFrame([], "id long")
        q, cells, own, names = asked
        return N.reach_cells(q, self._reader(cells, names), own, least, block, N.any_within(least), "id long", T.Tables(self.spark)).distinct()
