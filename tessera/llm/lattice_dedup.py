"""Embedding near-dedup by lattice hashing (operator 1).

Unit vectors are turned by a random rotation and cut into tables of 16 coordinates, each two E8 blocks; a block,
scaled, is decoded to its nearest E8 lattice point, and a table's two points are its cell. If two unit vectors lie
within r, then in at least one of the T tables they lie within r / sqrt(T), and the point half way between them lies within half of that of
both. So each vector is put in its home cell of every table and in every neighbouring cell that may hold a point as near as that half: E8's cell
walls around a point are the bisectors to the 240 shortest vectors, and a cell further off is behind the bisector to one of the 2160 next ones, so the
distance to those bisectors tells which cells to probe. Two vectors within r then share the cell of their middle, and the search misses no
pair. Cosines are verified in double precision.

A pair is counted in the first table in which it is that near, in the cell of its middle, so no pairs are kept to remove repetitions. Cells with
many vectors are cut into blocks; a task compares one block with another and returns sums and a
spanning forest, never pairs. Copies of a vector are compared once and counted by weight.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._components import components
from tessera.llm._store import Kept, few_files, whole_runs
from tessera.llm._text import mix64
from tessera.llm._vectors import directions, join_groups, keyed, matrices, usable

BLOCK, PER_TABLE, REACH = 8, 2, 0.15


def e8_shells() -> np.ndarray:
    """The 240 vectors of squared length 2 and the 2160 of squared length 4."""
    found = []
    for shift, span in ((0.0, (-2, -1, 0, 1, 2)), (0.5, (-2, -1, 0, 1))):
        def grow(prefix: tuple, norm: float) -> None:
            if len(prefix) == BLOCK:
                if sum(prefix) % 2 == 0 and norm in (2.0, 4.0):
                    found.append(prefix)
                return
            for c in span:
                if norm + (c + shift) ** 2 <= 4.0:
                    grow((*prefix, c + shift), norm + (c + shift) ** 2)
        grow((), 0.0)
    return np.array(sorted(found))


def e8_decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, the union of D8 and D8 + 1/2, to each row."""

    def d8(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        gap = y - near
        odd = near.sum(axis=1) % 2 != 0
        worst = np.abs(gap).argmax(axis=1)
        rows = np.flatnonzero(odd)
        near[rows, worst[rows]] += np.where(gap[rows, worst[rows]] >= 0, 1.0, -1.0)
        return near

    one, two = d8(x), d8(x - 0.5) + 0.5
    return np.where((((x - one) ** 2).sum(axis=1) <= ((x - two) ** 2).sum(axis=1))[:, None], one, two)


def rotation(d: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix over d coordinates, padded to whole tables."""
    width = BLOCK * PER_TABLE
    full = -(-d // width) * width
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((full, full)))
    return (q * np.sign(np.diag(r)))[:d]


def cell_key(points: np.ndarray) -> np.ndarray:
    """A 64-bit key of rows of half-integers."""
    out = np.zeros(len(points), np.uint64)
    for c in np.rint(points * 2).astype(np.int64).astype(np.uint64).T:
        out = mix64(out * np.uint64(31) + c)
    return out.view(np.int64)


def _full_key(points: np.ndarray, label: np.ndarray, dim: int, table: int) -> np.ndarray:
    """The key of a cell among the vectors of one label and length."""
    return mix64(cell_key(points).view(np.uint64) ^ mix64(label.view(np.uint64) + np.uint64(dim << 16 | table))).view(np.int64)


def _scale(threshold: float, tables: int, reach: float) -> float:
    """What makes half of the distance that two vectors at the threshold have in some table ``reach`` in the lattice."""
    return 2 * reach / max(math.sqrt((2 - 2 * threshold) / tables), 1e-6)


def _hasher(threshold: float, reach: float, seed: int):
    """(cell, tab, id): the cells of each vector."""

    def run(batches):
        shells = e8_shells()
        length = np.linalg.norm(shells, axis=1)
        unit, half = (shells / length[:, None]).T, length / 2
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, labels = batch.column("id").to_numpy(), batch.column("l1").to_numpy()
            for rows, x in matrices(batch.column("vector")):
                for at in range(0, len(rows), 512):
                    some, part = rows[at : at + 512], directions(x[at : at + 512])
                    d = part.shape[1]
                    turn = turns.setdefault(d, rotation(d, seed))
                    tables = turn.shape[1] // (BLOCK * PER_TABLE)
                    y = part @ turn * _scale(threshold, tables, reach)
                    most = reach * (1 + 1e-6) + 1e-9
                    for t in range(tables):
                        near = []
                        for b in range(PER_TABLE):
                            z = y[:, (t * PER_TABLE + b) * BLOCK :][:, :BLOCK]
                            c = e8_decode(z)
                            wall = half - (z - c) @ unit
                            i, v = np.nonzero(wall <= most)
                            # the home cell, then the neighbours
                            owner = np.concatenate([np.arange(len(z)), i])
                            point = np.concatenate([c, c[i] + shells[v]])
                            far = np.concatenate([np.zeros(len(z)), np.maximum(wall[i, v], 0)])
                            order = np.argsort(owner, kind="stable")
                            near.append((owner[order], point[order], far[order]))
                        (o1, p1, f1), (o2, p2, f2) = near
                        n2 = np.bincount(o2, minlength=len(part))
                        begin2 = np.concatenate([[0], np.cumsum(n2)])
                        left = np.repeat(np.arange(len(o1)), n2[o1])
                        step = np.arange(len(left)) - np.repeat(np.cumsum(n2[o1]) - n2[o1], n2[o1])
                        right = begin2[o1[left]] + step
                        ok = f1[left] ** 2 + f2[right] ** 2 <= most**2
                        left, right = left[ok], right[ok]
                        owner = some[o1[left]]
                        cell = _full_key(np.hstack([p1[left], p2[right]]), labels[owner], d, t)
                        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.full(len(owner), t, np.int32)), pa.array(ids[owner])], names=["cell", "tab", "id"])

    return run


def _pairs(starts: np.ndarray, inside: np.ndarray):
    """All pairs of rows of the same run, for the runs that are ``inside``, by the distance of the rows."""
    end = np.repeat(starts[1:], np.diff(starts))
    rows = np.flatnonzero(np.repeat(inside, np.diff(starts)))
    step = 1
    while len(rows):
        rows = rows[rows + step < end[rows]]
        yield rows, rows + step
        step += 1


def _verifier(threshold: float, reach: float, seed: int):
    def near(u: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = [np.einsum("ij,ij->i", u[i[c : c + 100_000]], u[j[c : c + 100_000]]) >= threshold for c in range(0, len(i), 100_000)]
        ok = np.concatenate([np.zeros(0, bool), *ok])
        return i[ok], j[ok]

    def run(batches):
        turns: dict[int, np.ndarray] = {}
        for rows, starts in whole_runs(batches, ["cell", "tab", "ba", "bb"]):
            rows = rows.combine_chunks()
            cell, tab, ba, bb, ids, weight, own, l1, l2 = (rows.column(c).to_numpy() for c in ("cell", "tab", "ba", "bb", "id", "copies", "own", "l1", "l2"))
            found = []
            lists = rows.column("vector").combine_chunks()
            lengths = np.diff(np.asarray(lists.offsets))
            flat = np.asarray(lists.flatten(), np.float64)
            at = np.concatenate([[0], np.cumsum(lengths)])
            size = np.diff(starts)
            for d in np.unique(lengths[starts[:-1]]):  # the vectors of a run have one length
                runs_ = np.flatnonzero(lengths[starts[:-1]] == d)
                of = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in runs_]) if len(runs_) < len(size) else np.arange(len(rows))
                u = np.zeros((len(rows), d))
                u[of] = directions(flat[at[of][:, None] + np.arange(d)])
                small = (size <= 64) & (ba[starts[:-1]] == bb[starts[:-1]]) & (lengths[starts[:-1]] == d)
                found += [(d, u, *near(u, i, j)) for i, j in _pairs(starts, small)]
                for r in runs_[~small[runs_]]:
                    some = np.arange(starts[r], starts[r + 1])
                    left, right = some[own[some] == ba[some[0]]], some[own[some] == bb[some[0]]]
                    i, j = np.nonzero(u[left] @ u[right].T >= threshold)
                    i, j = left[i], right[j]
                    apart = (i < j) | (ba[i] != bb[i])
                    found.append((d, u, i[apart], j[apart]))
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for d, u, i, j in found:
                same = (l1[i] == l1[j]) & (l2[i] == l2[j])
                i, j = i[same], j[same]
                turn = turns.setdefault(d, rotation(d, seed))
                width = BLOCK * PER_TABLE
                tables = turn.shape[1] // width
                scale = _scale(threshold, tables, reach)
                most = (2 - 2 * threshold) / tables * (1 + 1e-9) + 1e-15
                for c in range(0, len(i), 65536):
                    # counted in the first table in which the pair is near enough, where its middle lies
                    a, b = i[c : c + 65536], j[c : c + 65536]
                    ya, yb = u[a] @ turn, u[b] @ turn
                    gap = ((ya - yb) ** 2).reshape(len(a), tables, width).sum(axis=2) <= most
                    here = gap.any(axis=1) & (gap.argmax(axis=1) == tab[a])
                    a, b, middle = a[here], b[here], ((ya + yb) / 2 * scale)[here]
                    middle = middle.reshape(len(a), tables, width)[np.arange(len(a)), tab[a]]
                    home = np.hstack([e8_decode(middle[:, k * BLOCK :][:, :BLOCK]) for k in range(PER_TABLE)])
                    counts = np.zeros(len(a), bool)
                    for t in np.unique(tab[a]):
                        at_t = tab[a] == t
                        counts[at_t] = _full_key(home[at_t], l1[a][at_t], int(d), int(t)) == cell[a][at_t]
                    left.append(a[counts])
                    right.append(b[counts])
            i, j = np.concatenate(left), np.concatenate(right)
            if not len(i):
                continue
            names, local = np.unique(ids[np.concatenate([i, j])], return_inverse=True)
            links = np.zeros(len(names), np.int64)
            np.add.at(links, local[: len(i)], weight[j])
            np.add.at(links, local[len(i) :], weight[i])
            root = join_groups(len(names), local[: len(i)], local[len(i) :])
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(links), pa.array(names[root])], names=["id", "links", "root"])

    return run


def lattice_links(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = 0.98, reach: float = REACH, block: int = 2048, seed: int = 20240229,
) -> DataFrame:
    """All rows with ``n_links``, ``component_id`` and ``kept``; rows are compared if their labels are equal and not null.

    Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label
    or id, link with nothing; vectors of different lengths are not compared; rows that share an id are vectors of
    their own; lengths and components of any size are scaled first; extra columns are not read. ``block`` bounds the vectors that a task compares with
    others at once. A larger ``reach``, up to 0.22, makes cells finer, so that there are more of them for each vector and fewer vectors in each; the result is the same.
    """
    if reach >= math.sqrt(6) / 2 - 1:
        raise ValueError("the lattice is too fine: cells beyond the next ones would have to be probed")
    spark = vectors.sparkSession
    kept = Kept(spark)
    base = keyed(vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")), "vector")
    base = base.withColumn("part", usable(F.col("vector")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    used = base.where("part")
    groups = used.groupBy("label", "k1", "k2").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    named = groups.withColumn("id", F.xxhash64("label", "k1", "k2")).withColumn("l1", F.xxhash64("label")).withColumn("l2", F.xxhash64(F.lit(0x1ABE1), "label"))
    reps = kept.put(named, "vectors")  # ids of rows may repeat
    cells = kept.put(reps.select("id", "l1", "vector").mapInArrow(_hasher(threshold, reach, seed), "cell long, tab int, id long"), "cells", whole=True)
    met = kept.put(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    placed = cells.join(met, "cell").withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    keys = ["cell", "tab", "ba", "bb"]
    units = placed.select("cell", "tab", F.least("own", "other").alias("ba"), F.greatest("own", "other").alias("bb"), "own", "id")
    units = units.join(reps.select("id", "copies", "l1", "l2", "vector"), "id").repartition(*keys).sortWithinPartitions(*keys)
    found = kept.put(units.mapInArrow(_verifier(threshold, reach, seed), "id long, links long, root long"), "links")
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    member = kept.put(
        reps.select("label", "k1", "k2", "copies", "least", F.col("id").alias("rep"))
        .join(sums, F.col("rep") == sums.id, "left").drop("id")
        .join(joined, F.col("rep") == joined.node, "left").drop("node"),
        "member",
    )
    lowest = member.where("component is not null").groupBy("component").agg(F.min("least").alias("lowest"))
    told = kept.put(member.join(lowest, "component", "left").select("label", "k1", "k2", "copies", "links", F.coalesce("lowest", "least").alias("rep")), "told")
    kept.drop(cells, met, found, joined, member)
    rows = base.withColumn("label", F.when(F.col("part"), F.col("label")))
    out = rows.join(told, ["label", "k1", "k2"], "left")
    told = out.select(
        F.col("id").alias(id_col),
        F.when(F.col("part"), F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("part"), F.col("rep")).otherwise(F.col("id")).cast("long").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
    return few_files(told)
