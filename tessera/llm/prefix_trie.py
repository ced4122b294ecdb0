"""The trie of conversations that start alike, built level by level (operator 13).

Turns are numbered without a window over a whole conversation, equal conversations are merged by a digest of all their turns,
and then each level groups the conversations that still share a node by (parent node, next turn), giving the smallest id. A conversation that
is alone in its node is a chain from there on and leaves the loop. Leaves and savings are rolled up by joins, the deepest level first.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._store import Kept

#: Turns of a conversation that one window orders, and ids that one task sorts.
WIDE = 1024
EMPTY_SHA = hashlib.sha256().hexdigest()


def _kept(kept: Kept | None, df: DataFrame) -> Kept:
    return kept or Kept(df.sparkSession)


def numbered_turns(chats: DataFrame, texts: bool = False, kept: Kept | None = None) -> DataFrame:
    """(conv_id, pos, turn_id, size) of all turns: pos counts from 1 in order of turn (nulls first), role and text; turn_id is a digest of role and text, size
    the text's code points. With ``texts`` role and text follow.

    Null roles and texts count as empty. Rows without a conv_id belong to no conversation and are left out. Rows are sorted over the cluster by ranges of the whole
    key, equal rows by their place in the input too, so a conversation of any length and any number of equal turns is no one task's burden.
    """
    kept = _kept(kept, chats)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = chats.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    turn_id = F.unhex(F.substring(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(" "), F.col("role"), F.col("text")).cast("binary"), 256), 1, 32))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text", "spread"]
    rows = rows.withColumn("spread", F.monotonically_increasing_id() % 4096)
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    own = [turn_id.alias("turn_id"), F.char_length("text").cast("long").alias("size"), *(["role", "text"] if texts else [])]
    rows = kept.put(rows.select("conv_id", *own, F.monotonically_increasing_id().alias("place")), "turns", whole=True)
    ranges = rows.groupBy("conv_id", F.shiftright("place", 33).alias("part")).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    shift = ranges.select("conv_id", "part", (F.col("first") - before).alias("shift"))
    told = rows.withColumn("part", F.shiftright("place", 33)).join(shift, ["conv_id", "part"])
    return told.select("conv_id", (F.col("place") - F.col("shift") + 1).alias("pos"), "turn_id", "size", *(["role", "text"] if texts else []))


def respliced(turns: DataFrame, group: int = 100, kinds: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): each conversation c with the first h = crc32(c) % ``kinds`` turns of conversation c - c % ``group`` in place of its own first h."""
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % kinds
    convs = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    heads = turns.where((F.col("pos") < kinds) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "base")  # under ``kinds`` rows each
    first = convs.join(heads, "base").where("pos <= h").select("conv_id", "pos", *[c for c in turns.columns if c not in ("conv_id", "pos")])
    had = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("m")), "base", "left").withColumn("m", F.least("h", F.coalesce("m", F.lit(0))))
    rest = turns.join(had.select("conv_id", "h", "m"), "conv_id").where("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("m"))
    return first.unionByName(rest.select(*first.columns)), convs.select("conv_id")


def _prints(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, length, x, y): a digest of each conversation, the exclusive or of its turns' hashes, each with its place, so that it is summed up before
    anything is shuffled. Conversations without turns have zeros."""
    mixed = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "pos", "turn_id"))
    whole = turns.groupBy("conv_id").agg(F.count("*").alias("length"), mixed(1).alias("x"), mixed(2).alias("y"))
    nothing = F.lit(0).cast("long")
    rest = convs.join(whole.select("conv_id"), "conv_id", "left_anti")
    return whole.unionByName(rest.select("conv_id", nothing.alias("length"), nothing.alias("x"), nothing.alias("y")))


def _digests(batches):
    """(rep, ends) of sorted (rep, told): SHA-256 of the pieces of each rep, commas between them."""
    last, state = None, None
    for batch in batches:
        done: list[tuple[int, str]] = []
        for rep, told in zip(batch.column("rep").to_pylist(), batch.column("told").to_pylist()):
            if state is not None and rep == last:
                state.update(b"," + told.encode())
                continue
            if state is not None:
                done.append((last, state.hexdigest()))
            last, state = rep, hashlib.sha256(told.encode())
        yield pa.RecordBatch.from_pydict({"rep": pa.array([d[0] for d in done], pa.int64()), "ends": pa.array([d[1] for d in done], pa.string())})
    if state is not None:
        yield pa.RecordBatch.from_pydict({"rep": pa.array([last], pa.int64()), "ends": pa.array([state.hexdigest()], pa.string())})


def _ends(members: DataFrame) -> DataFrame:
    """(rep, ends): SHA-256 of the ids of each rep's members in order. Ids are sorted and joined within ranges of WIDE values, so no task holds
    a class; its digest, which is sequential, takes one piece after another."""
    pieces = members.groupBy("rep", F.floor(F.col("conv_id") / WIDE).alias("part"))
    pieces = pieces.agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("told"))
    return pieces.repartition("rep").sortWithinPartitions("rep", "part").select("rep", "told").mapInArrow(_digests, "rep long, ends string")


def _tails(turns: DataFrame) -> DataFrame:
    """``turns`` (rep, pos, size, ...) with ``tail``, the sizes summed from each turn to the last: within stretches of WIDE turns, and of the stretches after."""
    stretch = F.floor(F.col("pos") / WIDE).alias("stretch")
    sums = turns.groupBy("rep", stretch).agg(F.sum("size").alias("s"))
    after = sums.withColumn("after", F.sum("s").over(W.partitionBy("rep").orderBy(F.desc("stretch")).rowsBetween(W.unboundedPreceding, -1)))
    own = turns.withColumn("stretch", stretch).withColumn("own", F.sum("size").over(W.partitionBy("rep", "stretch").orderBy(F.desc("pos"))))
    told = own.join(after.select("rep", "stretch", "after"), ["rep", "stretch"])
    return told.withColumn("tail", F.col("own") + F.coalesce("after", F.lit(0))).drop("stretch", "own", "after")


def prefix_trie(turns: DataFrame, convs: DataFrame | None = None, kept: Kept | None = None) -> DataFrame:
    """One row for each node: conv_id (its smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has (conv_id, pos from 1 without gaps, turn_id, size), as ``numbered_turns`` gives them; ``convs`` names conversations that may have no turns. A node is known by
    its depth and smallest member. saved_tokens sums (n_convs - 1) x size of a node's last turn over its subtree; ends_sha256 is the digest of the ids, in order and joined by
    commas, of members that end there. An empty table has no node, not even a root. Groups of any size are counted before they are shuffled.
    """
    spark = turns.sparkSession
    kept = _kept(kept, turns)
    convs = turns.select("conv_id").distinct() if convs is None else convs.distinct()
    turns = turns.select("conv_id", "pos", "turn_id", "size")
    prints = kept.put(_prints(turns, convs), "trie-prints")
    groups = kept.put(prints.groupBy("length", "x", "y").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n")), "trie-groups")
    if groups.isEmpty():
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    shared = prints.join(groups.where("n > 1"), ["length", "x", "y"]).select("rep", "conv_id")
    ends = _ends(shared)
    alone = F.sha2(F.col("rep").cast("string").cast("binary"), 256)
    classes = kept.put(groups.join(ends, "rep", "left").select("rep", "n", "length", F.coalesce("ends", alone).alias("ends")), "trie-classes")
    own = turns.join(classes.select(F.col("rep").alias("conv_id")), "conv_id", "left_semi").withColumnRenamed("conv_id", "rep")
    own = kept.put(_tails(own).sortWithinPartitions("pos"), "trie-turns")  # sorted, so that a level reads only its row groups

    root = classes.agg(F.min("rep").alias("node"), F.sum("n").alias("n_convs"), F.max(F.when(F.col("length") == 0, F.col("ends"))).alias("ends")).select("node", F.lit(None).cast("long").alias("parent"), "n_convs", F.lit(0).cast("long").alias("size"), "ends")
    levels = [kept.put(root, "trie-level-0")]
    first = classes.agg(F.min("rep")).first()[0]
    live = classes.where("length > 0").select("rep", "n", "length", "ends", F.lit(first).cast("long").alias("parent"))
    single: list[DataFrame] = []
    some = classes.where("length > 0")
    while not some.isEmpty():
        depth = len(levels)
        step = kept.put(live.join(own.where(F.col("pos") == depth).select("rep", "turn_id", "size"), "rep"), f"trie-step-{depth}")
        at_end = F.col("length") == depth
        nodes = step.groupBy("parent", "turn_id").agg(
            F.min("rep").alias("node"), F.sum("n").alias("n_convs"), F.count("*").alias("m"), F.first("size").alias("size"), F.max(F.when(at_end, F.col("ends"))).alias("ends"),
            F.count_if(~at_end).alias("more"),
        )
        nodes = kept.put(nodes, f"trie-nodes-{depth}")
        levels.append(nodes.where("m > 1").select("node", "parent", "n_convs", "size", "ends"))
        single.append(nodes.where("m = 1").select(F.col("node").alias("rep"), "parent", F.lit(depth).alias("top")))
        some = nodes.where("m > 1 and more > 0").select("parent", "turn_id", "node")
        live = step.where(~at_end).join(some, ["parent", "turn_id"]).select("rep", "n", "length", "ends", F.col("node").alias("parent"))

    tops = functools.reduce(DataFrame.unionByName, single) if single else None
    chains, tails = None, None
    if tops is not None:
        known = tops.join(classes, "rep")
        rows = own.join(known, "rep").where("pos >= top")
        ends_here = F.when(F.col("pos") == F.col("length"), F.col("ends")).otherwise(F.lit(EMPTY_SHA))
        chains = rows.select(
            F.col("rep").alias("conv_id"), F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("top"), F.col("parent")).otherwise(F.col("rep")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
            (F.col("pos") < F.col("length")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("tail")).alias("saved_tokens"), ends_here.alias("ends_sha256"),
        )
        tails = kept.put(rows.where("pos = top").groupBy("parent", "top").agg(F.count("*").alias("children"), F.count("*").alias("leaves"), F.sum((F.col("n") - 1) * F.col("tail")).alias("saved")), "trie-tails")

    done: list[DataFrame] = []
    below: DataFrame | None = None
    for depth in reversed(range(len(levels))):
        parts = [] if tails is None else [tails.where(F.col("top") == depth + 1).drop("top")]
        if below is not None:
            parts.append(below.groupBy("parent").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")))
        level = levels[depth]
        nothing = F.lit(0).cast("long")
        if parts:
            sums = functools.reduce(DataFrame.unionByName, parts).groupBy(F.col("parent").alias("node")).agg(*(F.sum(c).alias(c) for c in ("children", "leaves", "saved")))
            level = level.join(sums, "node", "left")
        else:
            level = level.withColumns({"children": nothing, "leaves": nothing, "saved": nothing})
        level = level.select(
            "node", "parent", "n_convs", F.coalesce("children", nothing).alias("n_children"), F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"),
            (F.coalesce("saved", nothing) + (F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256"),
        )
        if not parts:
            level = level.withColumn("n_leaves", F.lit(1).cast("long"))
        below = kept.put(level, f"trie-sums-{depth}")
        done.append(below.select(F.col("node").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
    return functools.reduce(DataFrame.unionByName, [*done, *([chains] if chains is not None else [])])
