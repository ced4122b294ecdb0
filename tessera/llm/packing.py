"""Best-fit packing of token pieces with swap-based local search (operator 2).

A plan needs only how many pieces have each length, at most ``capacity`` numbers for any corpus, so the driver packs
classes of equal bins instead of bins: best-fit decreasing over the lengths, then a local search between underfull classes
that moves a piece, or exchanges one for one or two for one, whenever that increases the sum of squared fills, until bins
empty or no exchange helps. A piece's place follows from its rank among the pieces of its length: a count within
its task plus the counts of the tasks before.
"""

from __future__ import annotations

import heapq
import logging
import zlib
from bisect import bisect_left, insort
from collections import Counter
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._store import Kept, few_files
from tessera.llm._text import Words, pieces, utf8

log = logging.getLogger(__name__)

Bins = Counter  # pattern (lengths, largest first) -> number of such bins


def best_fit(counts: dict[int, int], capacity: int) -> Bins:
    """Best-fit decreasing over classes of equal bins."""
    open_: dict[int, Counter] = {}  # room -> patterns
    rooms: list[int] = []

    def put(pattern: tuple, number: int) -> None:
        room = capacity - sum(pattern)
        if room not in open_:
            open_[room] = Counter()
            insort(rooms, room)
        open_[room][pattern] += number

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if left >= each:
                    put((length,) * each, left // each)
                    left %= each
                if left:
                    put((length,) * left, 1)
                break
            room = rooms[at]
            pattern, number = open_[room].popitem()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            used = min(left, number)
            if used < number:
                put(pattern, number - used)
            put((*pattern, length), used)
            left -= used
    return Counter({p: n for group in open_.values() for p, n in group.items()})


def _exchange(a: tuple, b: tuple, room: int, gain: int) -> tuple[tuple, tuple] | None:
    """The lengths to give from ``a`` and to take from ``b`` that raise b's fill most, by over ``gain`` and at most ``room``."""
    best, found = gain, None
    items, others = sorted(set(a)), sorted(set(b))
    times = Counter(a)
    pairs = [(x + y, (x, y)) for i, x in enumerate(items) for y in items[i:] if x != y or times[x] > 1]
    for size, give in [(x, (x,)) for x in items] + pairs:
        if len(give) == 1 and best < size <= room:
            best, found = size, (give, ())
        # the least length that leaves size - length within the room gains most
        at = bisect_left(others, size - room)
        if at < len(others) and best < size - others[at] <= room:
            best, found = size - others[at], (give, (others[at],))
        if best == room:
            break
    return found


def local_search(bins: Bins, capacity: int, steps: int | None = None) -> Bins:
    """Moves and exchanges between underfull classes. Each exchange increases the sum of squared fills, so the search ends by itself, when none
    is left or the pieces fill no fewer bins. ``steps`` looks at pairs of classes bound its time; a search that is stopped says so, and leaves
    a packing that is whole, only less tight."""
    left = float("inf") if steps is None else steps
    bins = Counter(bins)
    least = -(-sum(sum(p) * n for p, n in bins.items()) // capacity)
    total = sum(bins.values())
    heap = [(sum(p), p) for p in bins if sum(p) < capacity]
    heapq.heapify(heap)
    while heap and total > least and left > 0:
        fill, a = heapq.heappop(heap)
        if not bins.get(a):
            continue
        under = sorted(((sum(p), p) for p, n in bins.items() if sum(p) < capacity and (p != a or n > 1)), reverse=True)
        for other, b in under:
            left -= 1
            if other < fill or left <= 0:
                break
            if not (found := _exchange(a, b, capacity - other, 0)):
                continue
            give, take = found
            number = bins[a] // 2 if a == b else min(bins[a], bins[b])
            new = []
            for p, minus, plus in ((a, give, take), (b, take, give)):
                rest = list(p)
                for x in minus:
                    rest.remove(x)
                new.append(tuple(sorted([*rest, *plus], reverse=True)))
            for p in (a, b):
                bins[p] -= number
                if not bins[p]:
                    del bins[p]
            for p in new:
                if p:
                    bins[p] += number
                    if sum(p) < capacity:
                        heapq.heappush(heap, (sum(p), p))
                else:
                    total -= number
            if bins.get(a):
                heapq.heappush(heap, (fill, a))
            break
    if left <= 0:
        log.warning("local search: stopped after %s looks at pairs of classes, %s bins for a bound of %s", steps, total, least)
    return bins


def slots(bins: Bins) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset): rank r of the last row at or before it lies in sequence first + r - first rank."""
    found: dict[int, list] = {}
    used: Counter = Counter()
    sequence = 0
    for pattern in sorted(bins, reverse=True):
        offset = 0
        for length in pattern:
            found.setdefault(length, []).append((used[length], sequence, offset))
            used[length] += bins[pattern]
            offset += length
        sequence += bins[pattern]
    return {k: np.array(v, np.int64) for k, v in found.items()}


class WordIds:
    """Token ids of whole texts by a tokenizer that never joins what white space parts, nor ASCII letters to other ASCII signs; others are refused.

    Texts are cut there, with A-Z lowered if the tokenizer lowers them, and each distinct part is encoded once for as long as a worker lives: ``keys`` are the
    sorted hashes of the parts known, whose ids lie at ``at`` in ``flat``. Words with an apostrophe stay whole, as contractions do not end at one, and so do
    words with a special token of the tokenizer, whose case counts. Parts of one hash are told apart by a second, independent one (``check``): if they
    differ, the texts are encoded whole. At most MEMO parts are known at a time.
    """

    MEMO = 1_500_000
    known: dict[str, WordIds] = {}

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content.encode() for t in added]
        normal = self.tokenizer.normalizer
        self.lower = normal is not None and normal.normalize_str(ascii_uppercase) == ascii_lowercase
        if self.lower:
            self.special = [t.lower() for t in self.special]
        if any(t.lstrip or t.rstrip or t.single_word or t.content.split() != [t.content] for t in added) or not self._parts():
            raise ValueError(f"{path}: tokens reach over white space or from letters to signs")
        self.forget()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _parts(self) -> bool:
        """Whether the tokenizer cuts texts where this class does."""
        spaces = all(self._ids(f"ab{c}ab") == 2 * self._ids("ab") for c in " \t\n\r\v\f")
        signs = (chr(c) for c in range(0x21, 0x7F) if _SIGN[c] and c != ord("'"))
        return spaces and all(self._ids(f"a{c}a") == self._ids("a") + self._ids(c) + self._ids("a") for c in signs)

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in cls.known:
            cls.known[path] = cls(path)
        return cls.known[path]

    def forget(self) -> None:
        self.keys, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int32)
        self.size = np.zeros(0, np.int32)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _learn(self, keys: np.ndarray, check: np.ndarray, texts: list[str]) -> None:
        sizes, parts = [], []
        for begin in range(0, len(texts), 20_000):
            for told in self.tokenizer.encode_batch(texts[begin : begin + 20_000], add_special_tokens=False):
                ids = told.ids
                sizes.append(len(ids))
                parts += ids
            if self.used + len(parts) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(parts)), np.uint32)])
            self.flat[self.used : self.used + len(parts)] = parts
            self.used += len(parts)
            parts = []
        size = np.array(sizes, np.int64)
        at = self.used - int(size.sum()) + np.cumsum(size) - size
        where = np.searchsorted(self.keys, keys)
        self.keys, self.check = np.insert(self.keys, where, keys), np.insert(self.check, where, check)
        self.at, self.size = np.insert(self.at, where, at), np.insert(self.size, where, size)

    def __call__(self, texts: pa.Array, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the uint32 ids of each text, each followed by the id ``last``."""
        words = Words(texts, lower=self.lower)
        odd = split_signs(words, self.special)
        hashes, check = words.hashes(), words.hashes(1)
        raw = utf8(texts)[0] if len(odd) else words.bytes
        for i in odd.tolist():
            told = raw[words.start[i] : words.end[i]].tobytes()
            hashes[i], check[i] = xxhash.xxh64_intdigest(told, 2), xxhash.xxh64_intdigest(told, 3)
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.MEMO:
            self.forget()
        where = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[where] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            whole = set(odd.tolist())
            parts = [(raw[words.start[i] : words.end[i]].tobytes() if i in whole else words.text(i)).decode() for i in first[new].tolist()]
            self._learn(keys[new], check[first[new]], parts)
        where = np.searchsorted(self.keys, keys)
        if (self.check[where][inverse] != check).any():
            return self.plain(texts, last)
        size, begin = self.size[where].astype(np.int64), self.at[where].astype(np.int64)
        each = size[inverse]
        total = np.concatenate([[0], np.cumsum(each)])
        source = np.repeat(begin[inverse] - total[:-1], each) + np.arange(total[-1])
        of = total[words.of]
        return np.insert(self.flat[source], of[1:], np.uint32(last)), of + np.arange(len(of))


    def plain(self, texts: pa.Array, last: int) -> tuple[np.ndarray, np.ndarray]:
        """What a call gives, text by text."""
        told = [[*x.ids, last] for x in self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        return np.array([i for x in told for i in x], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in told])])


_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_SIGN = np.zeros(256, bool)
_SIGN[0x21:0x7F] = True
_SIGN[ord("A") : ord("Z") + 1] = _SIGN[ord("a") : ord("z") + 1] = False


def split_signs(words: Words, special: list[bytes]) -> np.ndarray:
    """Cuts words without an apostrophe or any of ``special`` between an ASCII letter and another printable ASCII sign, either way round. Gives the
    words with any of ``special``."""
    raw = words.bytes
    letter, sign = _LETTER[raw], _SIGN[raw]
    cut = np.zeros(len(raw), bool)
    cut[1:] = (letter[1:] & sign[:-1]) | (sign[1:] & letter[:-1])
    quote = np.concatenate([[0], np.cumsum(raw == ord("'"))])
    for i in np.flatnonzero(quote[words.end] > quote[words.start]).tolist():
        cut[words.start[i] : words.end[i]] = False
    found: list[int] = []
    flat = raw.tobytes()
    for token in special:
        at = flat.find(token)
        while at >= 0:
            found.append(at)
            at = flat.find(token, at + 1)
    where = np.searchsorted(words.start, np.array(found, np.int64), "right") - 1
    odd = words.start[where[np.array(found, np.int64) < words.end[where]]] if found else np.zeros(0, np.int64)
    for i in np.unique(where).tolist():
        cut[words.start[i] : words.end[i]] = False
    cut[words.offsets[words.offsets < len(raw)]] = False  # rows end there anyway
    places = np.flatnonzero(cut)
    words.start = np.sort(np.concatenate([words.start, places]))
    words.end = np.sort(np.concatenate([words.end, places]))
    words.of = np.searchsorted(words.start, words.offsets)
    return np.searchsorted(words.start, np.unique(odd))


def _pieces(tokenizer: str, capacity: int, last: int, output: str):
    def run(batches):
        encode = WordIds.of(tokenizer)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for first, part in pieces(batch.column("text")):
                ids, of = encode(part, last)
                size = np.diff(of)
                number = -(-size // capacity)
                row = np.repeat(np.arange(len(part)), number)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                start = piece * capacity
                length = np.minimum(capacity, size[row] - start)
                begin = of[row] + start
                order = np.argsort(length, kind="stable")
                run_ = length[order]
                head = np.flatnonzero(np.concatenate([[True], run_[1:] != run_[:-1]]))
                within = np.arange(len(run_)) - np.repeat(head, np.diff(np.concatenate([head, [len(run_)]])))
                rank = np.empty(len(row), np.int64)
                rank[order] = seen[run_] + within
                seen += np.bincount(length, minlength=capacity + 1)
                raw = memoryview(ids.astype("<u4").tobytes())
                cut = [raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), (begin + length).tolist())]
                told = pa.array([zlib.crc32(x) for x in cut], pa.int64()) if output == "crc32" else pa.array([bytes(x) for x in cut], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(first, len(part)).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), told, pa.array(np.full(len(row), task, np.int32)), pa.array(rank)],
                    names=["id", "piece", "start", "length", "ids", "task", "nth"],
                )

    return run


def _place(plan: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for k in np.unique(length):
                rows = np.flatnonzero(length == k)
                table = plan[int(k)]
                at = np.searchsorted(table[:, 0], rank[rows], "right") - 1
                sequence[rows] = table[at, 1] + rank[rows] - table[at, 0]
                offset[rows] = table[at, 2]
            keep = [batch.column(c) for c in ("id", "piece", "start", "length", "ids")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, last: int = 0, id_col: str = "doc_id", text_col: str = "text",
    output: str = "ids", steps: int | None = None,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids (binary, little-endian uint32; ``output="crc32"``: their
    checksum, a long), sequence_id, offset. A document is its ids and then ``last``; only documents over ``capacity`` are cut.

    ``tokenizer`` is a file at the same path on every worker; a text's ids are those of its plain call, special tokens that stand in the text included. One
    whose tokens reach over white space, or from letters to signs, is refused. Defined cases: null and empty texts are one piece, the id ``last``;
    a very long text is encoded whole and cut into pieces; rows with null or repeated ids are documents of their own; an empty table gives an
    empty result; extra columns are not read.
    """
    spark = docs.sparkSession
    kept = Kept(spark)
    kind = dict(docs.dtypes)[id_col]
    told = "long" if output == "crc32" else "binary"
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Written once: ranks count rows as they were written, whatever happens to executors later.
    cut = kept.put(base.mapInArrow(_pieces(tokenizer, capacity, last, output), f"id {kind}, piece int, start long, length long, ids {told}, task int, nth long"), "pieces", whole=True)
    by_task = kept.put(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = slots(local_search(best_fit(counts, capacity), capacity, steps))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.join(by_task.select("length", "task", before.alias("before")).hint("merge"), ["length", "task"])  # grows with the tasks
    placed = ranked.select("id", "piece", "start", "length", "ids", (F.col("before") + F.col("nth")).alias("rank"))
    out = placed.mapInArrow(_place(plan), f"id {kind}, piece int, start long, length long, ids {told}, sequence_id long, offset long")
    return few_files(out.withColumnRenamed("id", id_col))
