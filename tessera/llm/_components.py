"""Connected components of an edge table by repeated contraction.

Each round every node joins the neighbour (or itself) with the least pseudo-random rank of that round, and the
edges are mapped, stripped of loops and made distinct; so the edge table shrinks geometrically, also for long paths.
Minima are aggregated on the map side, so a node with very many edges costs its tasks no more than others.
Once at most SMALL edges are left, which is counted, one task joins them; until then no task holds more than its share.
Nothing is collected on the driver but the number of edges that are left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._store import Kept
from tessera.llm._vectors import join_groups

SMALL = 200_000


def _join_few(batches):
    edges = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if edges:
        a, b = (np.concatenate(x) for x in zip(*edges))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = join_groups(len(nodes), at[: len(a)], at[len(a) :])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node0", "to"])


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); component is the smallest node reachable.

    Null ends and loops are ignored; an empty table gives an empty result. Each round joins every node that has a neighbour of less rank, about half
    of them, so the rounds grow with the logarithm of the edges; there is no bound to them.
    """
    spark = edges.sparkSession
    kept = Kept(spark)
    left = kept.put(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct(), "edges")
    both = lambda e: e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both(left).select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    old = [left]
    turn = 0
    while True:
        count = left.count()
        if count <= small:
            moves = left.coalesce(1).mapInArrow(_join_few, "node0 long, to long")
        else:
            rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), c.alias("v"))
            least = both(left).groupBy("a").agg(F.min(rank(F.col("b"))).alias("m"))
            moves = kept.put(least.select(F.col("a").alias("node0"), F.least("m", rank(F.col("a")))["v"].alias("to")), "moves")
        labels = kept.put(labels.join(moves, labels.root == moves.node0, "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        if count <= small:
            break
        one = left.join(moves, left.a == moves.node0).select(F.col("to").alias("a"), "b")
        two = one.join(moves, one.b == moves.node0).select("a", F.col("to").alias("b")).where("a <> b")
        left = kept.put(two.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        kept.drop(*old, moves)
        old = [left, labels]
        turn += 1
    lowest = labels.groupBy("root").agg(F.min("node").alias("component"))
    out = kept.put(labels.join(lowest, "root").select("node", "component"), "components")
    kept.drop(*old, labels)
    return out
