"""N-gram Jaccard self-join by a MinHash LSH forest (operator 5).

A document is its set of word 5-grams (fewer words: one gram of them all). Documents of equal words are joined once and
counted by weight. Each tree of the forest labels a document with a sequence of minhashes; all labels of a tree are sorted, over the
whole cluster, and a sorted run of labels is a prefix trie: two documents share a node as deep as the common prefix of the labels between them. A
document's prefix starts at its whole label and is shortened, node by node, until a pair with it at the lowest similarity that it can have meets in
some tree with the target recall: a set of a few grams can only be similar to another if they are nearly equal, so it stays at a deeper node than a large
one. Nodes that hold one document alone end there.

Documents that meet somewhere are gathered in candidate groups (connected components on ids alone). A group is cut at
random into chunks of bounded size, and only the chunk pairs that share a trie node are compared, with only the
documents in such nodes. So a text is shipped once for each chunk that it may have a partner in, and each pair of documents lies in one
unit. A unit counts the exact intersections of all its pairs by sparse products and returns sums and a spanning
forest, never pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._components import components
from tessera.llm._store import Kept, few_files, runs
from tessera.llm._text import Words, grams, mix64, pieces, within
from tessera.llm._vectors import join_groups


def forest_depth(trees: int, longest: int, threshold: float, recall: float) -> int:
    """The longest prefix at which a pair at the threshold meets in one of the trees with the recall asked for."""
    depth = longest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def forest_depths(trees: int, longest: int, threshold: float, recall: float, sizes: int = 64) -> np.ndarray:
    """For sets of 0, 1, 2, ... grams the prefix to which they are shortened, by the lowest similarity of at least the threshold that such a set can
    have with any other; larger sets go as the last."""
    found = []
    for m in range(sizes):
        whole = [k / (m + n - k) for n in range(1, 2 * m + 1) for k in range(1, min(m, n) + 1)] if m else []
        lowest = min((x for x in whole if x >= threshold), default=1.0)
        found.append(forest_depth(trees, longest, min(lowest, 1 - 1e-12), recall))
    return np.array([*found, forest_depth(trees, longest, threshold, recall)])


def shingles(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the n-gram hashes of each row of words, repeated ones included; short rows have one gram of all words."""
    valid, of = within(rows, n)
    out = grams(hashes, n)[valid]
    count = np.diff(rows)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = [grams(hashes[rows[i] : rows[i + 1]], int(count[i]), seed=1)[0] for i in short]
        out = np.insert(out, of[short], np.array(extra, np.uint64))
        add = np.zeros(len(of), np.int64)
        add[short + 1] = 1
        of = of + np.cumsum(add)
    return out, of


def word_keys(words: Words, hashes: np.ndarray, seeds: int = 2) -> list[np.ndarray]:
    """64-bit keys of the word sequence of each row, independent of each other down to the hashes of its words; ``hashes`` are those of seed 0."""
    of = words.of
    place = mix64((np.arange(len(hashes)) - np.repeat(of[:-1], np.diff(of))).astype(np.uint64))
    keys = []
    for seed in range(seeds):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64((words.hashes(seed) if seed else hashes) ^ place))])
        keys.append((total[of[1:]] - total[of[:-1]]).view(np.int64))
    return keys


def gram_counts(h: np.ndarray, of: np.ndarray, most: int) -> np.ndarray:
    """How many different grams each row has, up to ``most``."""
    count = np.diff(of)
    few = np.flatnonzero(count < most)
    rows = np.repeat(np.arange(len(count)), count)
    some = np.isin(rows, few)
    order = np.lexsort((h[some], rows[some]))
    one, row = h[some][order], rows[some][order]
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (row[1:] != row[:-1])
    return np.where(count < most, np.bincount(row[new], minlength=len(count)), most)


def _signer(n: int, trees: int, longest: int, depths: np.ndarray, seed: int):
    """For each document the keys of its words, their number, the prefix to which it is shortened, and its labels, one after the other."""

    def run(batches):
        rng = np.random.default_rng(seed)
        odd = rng.integers(1, 1 << 63, trees * longest, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        plus = rng.integers(0, 1 << 63, trees * longest, dtype=np.uint64)
        for batch in batches:
            for first, part in pieces(batch.column("text"), 1 << 20):
                words = Words(part)
                hashes = words.hashes()
                k1, k2 = word_keys(words, hashes)
                h, of = shingles(hashes, words.of, n)
                full = np.flatnonzero(np.diff(of) > 0)
                labels = np.zeros((len(part), trees * longest), ">u4")
                if len(full):
                    starts = of[full]
                    for k in range(trees * longest):
                        labels[full, k] = np.minimum.reduceat((h * odd[k] + plus[k]) >> np.uint64(32), starts)
                need = depths[gram_counts(h, of, len(depths) - 1)]
                raw = labels.tobytes()
                size = 4 * trees * longest
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(first, len(part)), pa.array(k1), pa.array(k2), pa.array(np.diff(words.of).astype(np.int64)), pa.array(need.astype(np.int32)),
                        pa.array([raw[size * i : size * (i + 1)] for i in range(len(part))], pa.binary()),
                    ],
                    names=["id", "k1", "k2", "words", "need", "labels"],
                )

    return run


def _climb(longest: int, depths: frozenset[int], seed: int):
    """The nodes (tree, node, rep, ends) in which a document of a sorted run of labels meets a neighbour; at the one to which it is shortened it
    ``ends``. A node is the hash of its prefix; what touches
    an end of the task's run may go on in the next, so it is given too."""

    def run(batches):
        held: tuple | None = None  # the last row of the batch before
        batches = iter(batches)
        batch = next(batches, None)
        while batch is not None:
            after = next(batches, None)
            tree, rep, need = (batch.column(c).to_numpy() for c in ("tree", "rep", "need"))
            label = np.frombuffer(b"".join(batch.column("label").to_pylist()), ">u4").reshape(-1, longest)
            if batch.num_rows:
                # the common prefix with the row before and the row after; unknown beyond the task
                equal = np.cumprod((label[1:] == label[:-1]) & (tree[1:] == tree[:-1])[:, None], axis=1).sum(axis=1)
                edge = lambda t, x, row: longest if t is None else (int(np.cumprod(x == label[row]).sum()) if t == tree[row] else 0)
                first = edge(None, None, 0) if held is None else edge(held[0], held[1], 0)
                if after is None or not after.num_rows:
                    last = longest
                else:
                    last = edge(after.column("tree")[0].as_py(), np.frombuffer(after.column("label")[0].as_py(), ">u4"), -1)
                common = np.maximum(np.concatenate([[first], equal]), np.concatenate([equal, [last]]))
                key = mix64(np.full(len(tree), seed, np.uint64) + tree.astype(np.uint64))
                for depth in range(1, longest + 1):
                    key = mix64(key * np.uint64(31) + label[:, depth - 1].astype(np.uint64))
                    if depth not in depths:
                        continue
                    # shortened to ``need``, a document meets at this depth those that are shortened no further
                    there = np.flatnonzero((common >= depth) & (need <= depth))
                    yield pa.RecordBatch.from_arrays([pa.array(tree[there]), pa.array(key[there].view(np.int64)), pa.array(rep[there]), pa.array(need[there] == depth)], names=["tree", "node", "rep", "ends"])
                held = (int(tree[-1]), label[-1].copy())
            batch = after

    return run


def _links(h: np.ndarray, of: np.ndarray, threshold: float, left: np.ndarray, right: np.ndarray, same: bool):
    """Pairs (i, j) of rows at the threshold: i of ``left``, j of ``right``, i < j if both sides are the same."""
    count = len(of) - 1
    row = np.repeat(np.arange(count), np.diff(of))
    order = np.lexsort((row, h))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[fresh], row[fresh]
    size = np.bincount(row, minlength=count)
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate([begin, [len(h)]]))
    shared = np.repeat(times > 1, times)
    row, gram = row[shared], np.repeat(np.cumsum(times > 1) - 1, times)[shared]
    both = np.zeros((len(left), len(right)), np.float32)
    at = np.full(count, -1)
    if len(row):
        a_at, b_at = at.copy(), at.copy()
        a_at[left], b_at[right] = np.arange(len(left)), np.arange(len(right))
        width = 4096
        cuts = np.searchsorted(gram, np.arange(0, gram[-1] + width + 1, width))
        for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
            g, r = gram[x:y] - k * width, row[x:y]
            if not len(g):
                continue
            a, b = np.zeros((len(left), g[-1] + 1), np.float32), np.zeros((len(right), g[-1] + 1), np.float32)
            ina, inb = a_at[r] >= 0, b_at[r] >= 0
            a[a_at[r[ina]], g[ina]] = 1
            b[b_at[r[inb]], g[inb]] = 1
            both += a @ b.T
    inter = both.astype(np.float64)
    union = size[left][:, None] + size[right][None, :] - inter
    ok = (inter > 0) & (inter / np.maximum(union, 1) >= threshold)
    if same:
        ok &= left[:, None] < right[None, :]
    i, j = np.nonzero(ok)
    return left[i], right[j]


def _verifier(n: int, threshold: float):
    def run(batches):
        out: list[tuple] = []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["rep", "links", "root"])

        for (ca, cb), rows in runs(batches, ["ca", "cb"]):
            if len(rows) < 2:
                continue
            ids, copies, chunk, key = (rows.column(c).to_numpy() for c in ("rep", "copies", "chunk", "k1"))
            parts, right_text = [], []
            for text in rows.column("text").chunks:
                for _, part in pieces(text):
                    words = Words(part)
                    hashes = words.hashes()
                    right_text.append(word_keys(words, hashes, 1)[0])
                    parts.append(shingles(hashes, words.of, n))
            if not (ok := np.concatenate(right_text) == key).all() or len(np.unique(ids)) < len(ids):
                ok &= np.isin(np.arange(len(ids)), np.unique(np.where(ok, ids, -1), return_index=True)[1])  # rows that share an id
            h = np.concatenate([x for x, _ in parts])
            of = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x) for _, x in parts]))])
            left, right = np.flatnonzero(ok & (chunk == ca)), np.flatnonzero(ok & (chunk == cb))
            i, j = _links(h, of, threshold, left, right, ca == cb)
            if not len(i):
                continue
            links = (np.bincount(i, weights=copies[j], minlength=len(ids)) + np.bincount(j, weights=copies[i], minlength=len(ids))).astype(np.int64)
            root = join_groups(len(ids), i, j)
            found = np.flatnonzero(links)
            out.append((ids[found], links[found], ids[root[found]]))
            if len(out) >= 2000:
                yield flush()
                out = []
        if out:
            yield flush()

    return run


def shingle_links(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8,
    trees: int = 20, longest: int = 8, recall: float = 0.9995, chunk: int = 1024, chunk_words: int = 500_000, seed: int = 11,
) -> DataFrame:
    """One row per document: ``n_links`` (documents whose sets of n-grams have a Jaccard similarity of at least
    ``threshold``), ``component_id`` (smallest id reachable by links, itself included) and ``kept`` (id = component_id).

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Defined cases: texts without words (null, empty) link with nothing; rows
    with a null id link with nothing and are kept; rows that repeat an id are one document, with the links of each of
    their texts; ids are whole numbers, and a column that cannot be cast to them raises; a very long text is hashed whole and compared by all its grams; an
    empty table gives an empty result; extra columns are not read.
    """
    spark = docs.sparkSession
    kept = Kept(spark)
    depths = forest_depths(trees, longest, threshold, recall)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    keys = kept.put(base.mapInArrow(_signer(n, trees, longest, depths, seed), "id long, k1 long, k2 long, words long, need int, labels binary"), "keys", whole=True)
    firsts = keys.where("words > 0").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies"), F.first("words").alias("words"), F.first("need").alias("need"), F.first("labels").alias("labels"))
    reps = kept.put(firsts, "reps")
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    label = F.substring(F.col("labels"), F.col("tree") * F.lit(4 * longest) + 1, F.lit(4 * longest)).alias("label")
    # sorted over all tasks, in even ranges: rows of equal labels are parted by their ids
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = reps.select("rep", "need", "labels", tree).select("tree", label, "rep", "need").repartitionByRange(parts, "tree", "label", "rep").sortWithinPartitions("tree", "label", "rep")
    nodes = kept.put(sorted_.mapInArrow(_climb(longest, frozenset(depths.tolist()), seed), "tree int, node long, rep long, ends boolean"), "nodes")
    # a node counts if it holds two documents, one of which is shortened no further: the others meet at a lower one anyway
    tops = nodes.groupBy("tree", "node").agg(F.min("rep").alias("top"), F.count("*").alias("size"), F.max("ends").alias("ends"))
    tops = tops.where("size > 1 and ends").select("tree", "node", "top")
    met = kept.put(nodes.drop("ends").join(tops, ["tree", "node"]).select("tree", "node", "rep", "top").distinct(), "met")
    groups = components(met.select(F.col("rep").alias("a"), F.col("top").alias("b")))
    known = reps.select("rep", "k1", "copies", "words")
    group = groups.join(known, groups.node == known.rep).select("component", "rep", "k1", "copies", "words")
    sizes = group.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / F.lit(chunk), F.sum("words") / F.lit(chunk_words))).alias("parts"))
    # a chunk's number is the hash of its group and part, so that chunks of two groups differ
    part = F.pmod(F.xxhash64("rep"), F.col("parts"))
    chunks = kept.put(group.join(sizes, "component").select("rep", "k1", "copies", F.xxhash64("component", part).alias("chunk")), "chunks")
    member = kept.put(met.join(chunks, "rep").select("tree", "node", "rep", "chunk").distinct(), "member")
    there = kept.put(member.select("tree", "node", F.col("chunk").alias("other")).distinct(), "there")
    pair = member.join(there, ["tree", "node"]).select("rep", F.least("chunk", "other").alias("ca"), F.greatest("chunk", "other").alias("cb")).distinct()
    units = kept.put(pair.join(chunks, "rep"), "units")
    # always by a sort-merge join: the units grow with the corpus, so they are never broadcast
    shipped = units.hint("merge").join(base, units.rep == base.id).select("ca", "cb", "rep", "k1", "copies", "chunk", "text").repartition("ca", "cb").sortWithinPartitions("ca", "cb")
    found = kept.put(shipped.mapInArrow(_verifier(n, threshold), "rep long, links long, root long"), "links")
    kept.drop(nodes, met, member, there, chunks, groups, units)
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    told = kept.put(
        reps.drop("labels", "need", "words").join(sums, "rep", "left").join(joined, F.col("rep") == joined.node, "left")
        .select("k1", "k2", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component")),
        "told",
    )
    kept.drop(found, joined)
    row = keys.join(told, ["k1", "k2"], "left").groupBy("id").agg(
        F.max(F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"), F.min(F.coalesce("component", "id")).cast("long").alias("component_id")
    )
    out = row.unionAll(docs.where(F.col(id_col).isNull()).select(F.col(id_col).cast("long"), F.lit(0).cast("long"), F.lit(None).cast("long")))
    return few_files(out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")))
