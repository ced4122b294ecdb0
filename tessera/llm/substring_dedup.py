"""Substring dedup over a log-structured fingerprint index (operator 6).

A window is ``window`` consecutive words. Each batch of documents becomes a sorted immutable run of fingerprints; it is
merge-joined with the runs of all earlier batches, what meets is verified on whole windows, and the smallest runs are compacted
as long as there are more than ``max_runs``. An index with a folder of its own can be opened again by a later session.

Fingerprints are of anchors: of every window the least hash among its half-window grams (all of them on ties). Equal
windows have equal anchors, so windows that recur anywhere hold an anchor that recurs; about one gram in thirteen is
an anchor. Only documents with recurring anchors are read again, and only windows around those are hashed whole, by two
64-bit hashes that are independent down to the hashes of the words; a window is a repetition if both occur in a document with a smaller id. A document of
the same words as an earlier one is known by its key and is not indexed again.

All counts are aggregated on the map side before a join, so that a passage of very many documents is no hot task.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._store import Kept, delete, exists, few_files, new_path, replace
from tessera.llm._text import Words, grams, mix64, pieces, within
from tessera.llm.shingle_join import word_keys


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each ``width`` consecutive items."""
    if len(x) < width:
        return x[:0]
    span = 1
    while span * 2 <= width:
        x = op(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return op(x[: len(x) - rest], x[rest:]) if rest else x


def _variant(k1: np.ndarray) -> np.ndarray:
    return k1.astype(np.int32)


def _anchors(window: int):
    """Per document: the key of its words, their number, and its different anchors."""
    half = window // 2
    reach = window - half

    def run(batches):
        for batch in batches:
            for first, part in pieces(batch.column("text")):
                words = Words(part)
                h, of = words.hashes(), words.of
                k1, k2 = word_keys(words, h)
                g = grams(h, half)
                fits, _ = within(of, window)
                least = np.where(fits, _sliding(g, reach + 1, np.minimum)[: len(fits)], 0)
                pad = np.zeros(reach, np.uint64)
                most = _sliding(np.concatenate([pad, least, pad]), reach + 1, np.maximum)
                at = np.flatnonzero((most[: len(g)] == g) & (g != 0)) if len(least) else np.zeros(0, np.int64)
                row = np.searchsorted(of, at, "right") - 1
                order = np.lexsort((g[at], row))
                at, row = at[order], row[order]
                new = np.ones(len(at), bool)
                new[1:] = (row[1:] != row[:-1]) | (g[at[1:]] != g[at[:-1]])
                at, row = at[new], row[new]
                cut = np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(first, len(part)),
                        pa.array(k1), pa.array(k2), pa.array(_variant(k1)), pa.array(np.diff(of).astype(np.int64)),
                        pa.ListArray.from_arrays(cut, pa.array(g[at].view(np.int64))),
                    ],
                    names=["id", "k1", "k2", "variant", "words", "fps"],
                )

    return run


def _windows(window: int):
    """Two hashes, document and starts of each different window that holds one of the given anchors."""
    half = window // 2
    reach = window - half

    def run(batches):
        for batch in batches:
            variants = batch.column("variant").to_numpy()
            for first, part in pieces(batch.column("text")):
                words = Words(part)
                h, of = words.hashes(), words.of
                fits, _ = within(of, window)
                right = _variant(word_keys(words, h, 1)[0]) == variants[first : first + len(part)]
                lists = batch.column("fps").slice(first, len(part))
                wanted = np.unique(lists.flatten().to_numpy().view(np.uint64))
                g = grams(h, half)
                size = len(fits)
                if not size or not len(wanted):
                    continue
                place = np.flatnonzero(np.isin(g, wanted))
                row = np.searchsorted(of, place, "right") - 1
                place, row = place[right[row]], row[right[row]]
                steps = np.zeros(size + 1, np.int32)
                np.add.at(steps, np.minimum(np.maximum(place - reach, of[row]), size), 1)
                np.add.at(steps, np.minimum(place + 1, size), -1)
                at = np.flatnonzero((np.cumsum(steps[:-1]) > 0) & fits)
                owner = np.searchsorted(of, at, "right") - 1
                keys = []
                for x in (h, words.hashes(1)):
                    g, tail = grams(x, half), grams(x, window - half)
                    keys.append(mix64(g[at] * np.uint64(0xD1342543DE82EF95) + tail[at + half]).view(np.int64))
                order = np.lexsort((at, keys[1], keys[0], owner))
                at, owner, one, two = at[order], owner[order], keys[0][order], keys[1][order]
                new = np.ones(len(at), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
                head = np.flatnonzero(new)
                ids = batch.column("id").to_numpy()[first : first + len(part)][owner[head]]
                told = variants[first : first + len(part)][owner[head]]
                starts = pa.ListArray.from_arrays(np.append(head, len(at)).astype(np.int32), pa.array((at - of[owner]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(one[head]), pa.array(two[head]), pa.array(ids), pa.array(told), starts], names=["h1", "h2", "id", "variant", "starts"])

    return run


class FingerprintIndex:
    """The runs of one growing corpus, in a folder that the whole cluster shares.

    ``add(docs)`` returns (id, variant, whole, starts) for the documents of the batch in which a window recurs, ``starts`` being those windows'
    first words, ``whole`` a document that is a copy throughout; and adds the batch to the index. Ids of a later batch must not be smaller than those of earlier ones, if a window
    is to be removed wherever it also starts in a document with a smaller id.

    With ``folder`` the index outlives its session: beside the runs it keeps the texts that it has indexed, one of each word sequence, and a list of
    what belongs to it, which is replaced last, so that a batch is either in the index or not. ``FingerprintIndex(spark, folder=folder)`` opens it
    again. Without, it reads the batches' own tables again and ``close`` deletes it.
    """

    def __init__(self, spark: SparkSession, window: int = 50, max_runs: int = 4, folder: str | None = None):
        if window < 2:
            raise ValueError("a window has two words at least")
        self.spark, self.window, self.max_runs, self.folder = spark, window, max_runs, folder
        self.kept = Kept(spark)
        self.runs: dict[str, int] = {}  # path and rows
        self.keys: str | None = None
        self.texts: list[str | DataFrame] = []
        self.compactions = 0
        if folder:
            told = [r["value"] for r in spark.read.text(f"{folder}/index").collect()] if exists(spark, f"{folder}/index") else []
            for x in map(json.loads, told):
                if x["window"] != window:
                    raise ValueError(f"the index has windows of {x['window']} words")
                self.runs, self.keys, self.texts = x["runs"], x["keys"], x["texts"]

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}-{uuid.uuid4().hex}" if self.folder else new_path(self.spark, name)

    def _read(self, run: str) -> DataFrame:
        return self.spark.read.schema("fp long, id long, variant int").parquet(run)

    def _write_run(self, anchors: DataFrame) -> tuple[str, int]:
        """A run is sorted by (fingerprint, id) and cut into ranges of both, so that a fingerprint of very many documents fills several files."""
        path = self._path("run")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        few_files(anchors.repartitionByRange(parts, "fp", "id").sortWithinPartitions("fp", "id")).write.parquet(path)  # neighbouring ranges
        return path, self._read(path).count()

    def compact(self, most: int = 1) -> list[str]:
        """Merges the two smallest runs until there are ``most``, so that runs grow by tiers. Gives the runs that are no more."""
        gone = []
        while len(self.runs) > most:
            small = sorted(self.runs, key=lambda x: (self.runs[x], x))[:2]
            path, rows = self._write_run(self._read(small[0]).unionByName(self._read(small[1])))
            for x in small:
                del self.runs[x]
            self.runs[path] = rows
            self.compactions += 1
            gone += small
        return gone

    def _save(self) -> None:
        """Lists what belongs to the index; the list is whole before it takes the place of the one before."""
        if not self.folder:
            return
        told = json.dumps({"window": self.window, "runs": self.runs, "keys": self.keys, "texts": self.texts})
        draft = self._path("draft")
        self.spark.createDataFrame([(told,)], "value string").coalesce(1).write.text(draft)
        replace(self.spark, draft, f"{self.folder}/index")

    def close(self) -> None:
        """Deletes an index without a folder of its own."""
        if not self.folder:
            for path in [*self.runs, *([self.keys] if self.keys else [])]:
                delete(self.spark, path)
            self.runs, self.keys, self.texts = {}, None, []

    def _text(self, x: str | DataFrame) -> DataFrame:
        return self.spark.read.schema("id long, text string").parquet(x) if isinstance(x, str) else x

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
        shape = "id long, k1 long, k2 long, variant int, words long, fps array<long>"
        scan = self.kept.put(base.mapInArrow(_anchors(self.window), shape).where(F.col("words") >= self.window), "scan", whole=True)
        firsts = scan.select("k1", "k2", "id")
        if self.keys:
            firsts = firsts.unionByName(self.spark.read.schema(firsts.schema).parquet(self.keys))
        keys = self._path("keys")
        few_files(firsts.groupBy("k1", "k2").agg(F.min("id").alias("id"))).write.parquet(keys)
        firsts = self.spark.read.schema(firsts.schema).parquet(keys)
        known = scan.join(firsts.withColumnRenamed("id", "first"), ["k1", "k2"])
        whole = known.where("first < id").select("id", "variant").distinct()
        new = known.where("first = id").select(F.explode("fps").alias("fp"), "id", "variant")
        earlier = list(self.runs)
        path, rows = self._write_run(new)
        run = self._read(path)
        # fingerprints of the batch that recur in it or in an earlier run
        mine = run.groupBy("fp").agg(F.min("id").alias("low"), F.max("id").alias("high"))
        meets = mine.where("low < high").select("fp")
        for name in earlier:
            meets = meets.unionByName(mine.select("fp").join(self._read(name).select("fp"), "fp", "left_semi"))
        meets = self.kept.put(meets.distinct(), "meets")
        hits = None
        for name in [*earlier, path]:
            found = self._read(name).join(meets, "fp", "left_semi").select("id", "variant", "fp")
            hits = found if hits is None else hits.unionByName(found)
        shared = hits.groupBy("id", "variant").agg(F.collect_set("fp").alias("fps"))
        texts = base
        for old in self.texts:
            texts = texts.unionByName(self._text(old))
        shape = "h1 long, h2 long, id long, variant int, starts array<int>"
        found = self.kept.put(shared.join(texts, "id").mapInArrow(_windows(self.window), shape), "windows")
        least = self.kept.put(found.groupBy("h1", "h2").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").drop("high"), "least")
        starts = found.join(least, ["h1", "h2"]).where("low < id").groupBy("id", "variant").agg(F.flatten(F.collect_list("starts")).alias("starts"))
        starts = starts.join(base.select("id").distinct(), "id", "left_semi") if earlier else starts
        out = self.kept.put(
            starts.select("id", "variant", F.lit(False).alias("whole"), "starts").unionByName(whole.select("id", "variant", F.lit(True).alias("whole"), F.array().cast("array<int>").alias("starts"))),
            "spans",
        )
        if self.folder:
            text = self._path("texts")
            base.join(new.select("id").distinct(), "id", "left_semi").write.parquet(text)
            self.texts.append(text)
        else:
            self.texts.append(base)
        self.kept.drop(scan, meets, found, least)
        old = [self.keys] if self.keys else []
        self.runs[path], self.keys = rows, keys
        old += self.compact(self.max_runs)
        self._save()
        for path in old:
            delete(self.spark, path)
        return out


def _keep(window: int, verbatim: bool):
    def run(batches):
        for batch in batches:
            for first, part in pieces(batch.column("text")):
                words = Words(part)
                of, n = words.of, len(part)
                drop = np.zeros(len(words) + 1, np.int32)
                told = batch.column("spans").slice(first, n)
                some = np.flatnonzero(np.asarray(told.is_valid()))
                if len(some):
                    key = _variant(word_keys(words, words.hashes(), 1)[0])
                    for i in some.tolist():
                        for span in told[i].as_py():
                            if span["variant"] != key[i]:
                                continue
                            at = np.zeros(1, np.int64) if span["whole"] else np.array(span["starts"], np.int64)
                            size = of[i + 1] - of[i] if span["whole"] else window
                            np.add.at(drop, of[i] + at, 1)
                            np.add.at(drop, of[i] + at + size, -1)
                gone = np.cumsum(drop[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[of[1:]] - total[of[:-1]]
                stay = np.flatnonzero(~gone)
                raw = words.bytes.copy()
                mark = np.zeros(len(raw) + 1, np.int32)
                np.add.at(mark, words.start[stay], 1)
                np.add.at(mark, words.end[stay], -1)
                mask = np.cumsum(mark[:-1]) > 0
                row = words.rows()[stay]
                follows = np.flatnonzero(row[1:] == row[:-1])
                gap = words.end[stay[follows]]
                mask[gap] = True
                raw[gap] = 0x20
                size = np.concatenate([[0], np.cumsum(mask)])[words.offsets].astype(np.int32)
                text = pa.StringArray.from_buffers(n, pa.py_buffer(size.tobytes()), pa.py_buffer(raw[mask].tobytes()))
                if verbatim:
                    text = pc.if_else(pa.array(removed > 0), text, part)
                rows = batch.slice(first, n)
                names = [x for x in rows.schema.names if x not in ("text", "spans")]
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(x) for x in names), pa.array(np.diff(of).astype(np.int64)), pa.array(removed.astype(np.int64)), text],
                    names=[*names, "n_words", "n_removed", "kept_text"],
                )

    return run


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, batches: int = 3, max_runs: int = 1,
    columns: tuple[str, ...] = (), verbatim: bool = False,
) -> DataFrame:
    """(id, ``columns``, n_words, n_removed, kept_text) for every row: each word is removed that is covered by a window whose word
    sequence also starts in a document with a smaller id; ``kept_text`` joins the words left by one
    space; with ``verbatim`` a text that loses no word stays as it is.

    The documents go through a FingerprintIndex in ``batches`` ranges of ids, smallest first, whose runs are compacted to ``max_runs`` after each. Ids
    are whole numbers; a column that cannot be cast to them raises. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Defined cases: null text has no
    words; texts of less than a window lose none; a very long text is hashed whole, in one pass; rows with
    a null id neither lose words nor take them from others; rows that repeat an id are no smaller than each other, so both
    keep what they share; an empty table gives an empty result; extra columns are not read. Of ``columns`` those that have the name of a result are left out
    for it.
    """
    spark = docs.sparkSession
    passed = [id_col, *(c for c in columns if c.lower() not in ("n_words", "n_removed", "kept_text"))]
    rows = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(passed)), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    cuts = sorted(set(rows.where("_id is not null").approxQuantile("_id", [k / batches for k in range(1, batches)], 0.01))) if batches > 1 else []
    index = FingerprintIndex(spark, window, max_runs)
    spans = None
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = rows.where("_id is not null")
        part = part if low is None else part.where(F.col("_id") > F.lit(int(low)))
        part = part if high is None else part.where(F.col("_id") <= F.lit(int(high)))
        found = index.add(part, "_id", "text")
        spans = found if spans is None else spans.unionByName(found)
    index.close()
    by_id = spans.groupBy("id").agg(F.collect_list(F.struct("variant", "whole", "starts")).alias("spans"))
    own = [f"_{i}" for i in range(len(passed))]
    joined = rows.join(by_id, rows._id == by_id.id, "left").select(*own, "text", "spans")
    shape = "".join(f"{c} {dict(docs.dtypes)[name]}, " for c, name in zip(own, passed)) + "n_words long, n_removed long, kept_text string"
    out = joined.mapInArrow(_keep(window, verbatim), shape)
    return few_files(out.select(*(F.col(c).alias(name) for c, name in zip(own, passed)), "n_words", "n_removed", "kept_text"))
