"""Interpolated modified Kneser-Ney n-gram model (operator 8).

Counting is in Spark. A first pass counts the tokens: the vocabulary is a sorted array of 64-bit hashes, cut into shards by their
leading bits, and a token's id is its place. A second pass counts n-grams of ids: each task reduces its rows to distinct n-grams and
packs them by shard, a function of the context; one task per shard adds them up and writes its part of the level. Lower
orders are counted from the distinct n-grams above them, which go from shard to shard in the same job. The number of shards follows the
tokens, so no task holds more than a few million n-grams; the driver gets one row of totals.

A shard of a level is one file of two sorted hash arrays, its n-grams with their counts and its contexts with their statistics. The
leading bits of a 64-bit hash are its bucket, the next 32 are stored: an n-gram takes some five bytes and its count one, and an unseen
one is taken for another about once in 10^9 lookups. Counts from 255 on stand in a list of their own, in 64 bits. Workers map the files into
memory; on a mounted folder they are mapped where they lie, else a worker fetches a shard once for all its tasks and
unlinks its copy once it is mapped. Tokens are looked up sorted by context, so shard by shard.

The probability of w after a context v is max(c(vw) - D, 0) / c(v) + (D1 N1(v) + D2 N2(v) + D3 N3(v)) / c(v) times that after the context
shortened by its first token; orders below the highest count distinct left neighbours instead of occurrences, and the lowest is interpolated
with 1 / (V + 1), V being the distinct tokens in training. A text is preceded by start symbols, which are not tokens,
and followed by one end token.
"""

from __future__ import annotations

import json
import os
import struct
import tempfile
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._store import brief_shuffles, delete, new_path, runs, small_batches
from tessera.llm._text import Words, mix64, pieces

END = np.uint64(0xE9D)
STEP = np.uint64(0xD1342543DE82EF95)
SALT = np.uint64(0x5851F42D4C957F2D)
SHARD_TOKENS, HELD = 4_000_000, 3_000_000
MANY = 255  # counts from here on stand in a list of their own


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): of each text the words, A-Z lowered, and the end token."""
    words = Words(column, lower=True)
    return np.insert(words.hashes(), words.of[1:], END), words.of + np.arange(len(words.of))


# Files of the shared folder.


def _local(uri: str) -> str | None:
    """The path of a folder that workers can map: one with a file: URI or without a scheme."""
    if uri.startswith("file:"):
        return "/" + uri.removeprefix("file:").lstrip("/")
    return uri if "://" not in uri else None


def write_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: the length of a JSON header, the header, and the arrays, each at a multiple of 8. It is written under a name of its own and
    renamed, so that a task that runs twice leaves one whole file."""
    about, at = {}, 0
    for key, x in arrays.items():
        about[key] = [x.dtype.str, len(x), at]
        at += -(-x.nbytes // 8) * 8
    head = json.dumps(about).encode()
    head += b" " * (-len(head) % 8)
    parts = [struct.pack("<Q", len(head)), head]
    for x in arrays.values():
        parts += [np.ascontiguousarray(x).data.cast("B") if len(x) else b"", b"\0" * (-x.nbytes % 8)]
    if path := _local(folder):
        os.makedirs(path, exist_ok=True)
        with tempfile.NamedTemporaryFile(dir=path, prefix=".", delete=False) as out:
            out.writelines(parts)
        os.replace(out.name, f"{path}/{name}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    draft = f"{path}/.{name}-{os.getpid()}"
    with store.open_output_stream(draft) as out:
        for x in parts:
            out.write(x)
    store.move(draft, f"{path}/{name}")


class Arrays:
    """The files of a folder, mapped when first asked for. Of a folder that is not mounted a worker keeps its copies of the last one's for its later
    tasks; else they are let go with the task, so that no worker holds the disk of a deleted model."""

    last: Arrays | None = None

    def __init__(self, folder: str):
        self.folder = folder
        self.open: dict[str, dict[str, np.ndarray]] = {}

    @classmethod
    def of(cls, folder: str) -> Arrays:
        if _local(folder):
            return cls(folder)
        if cls.last is None or cls.last.folder != folder:
            cls.last = cls(folder)
        return cls.last

    def _map(self, path: str) -> dict[str, np.ndarray]:
        raw = np.memmap(path, np.uint8, "r")
        size = 8 + int(raw[:8].view("<u8")[0])
        about = json.loads(raw[8:size].tobytes())
        return {k: raw[size + at : size + at + n * np.dtype(kind).itemsize].view(kind) for k, (kind, n, at) in about.items()}

    def __getitem__(self, name: str) -> dict[str, np.ndarray]:
        if name not in self.open:
            if path := _local(self.folder):
                self.open[name] = self._map(f"{path}/{name}")
            else:
                from pyarrow import fs

                store, path = fs.FileSystem.from_uri(self.folder)
                with tempfile.NamedTemporaryFile() as copy:
                    with store.open_input_stream(f"{path}/{name}") as source:
                        while part := source.read(1 << 20):
                            copy.write(part)
                    copy.flush()
                    self.open[name] = self._map(copy.name)  # the mapping outlives the name
        return self.open[name]


# Sorting. numpy sorts plain 64-bit numbers many times faster than it gives their order, so what belongs to a number is packed into it.


def rough_order(x: np.ndarray) -> np.ndarray:
    """An order of uint64 numbers by their leading bits, as many as the places leave of 64; equal numbers come in their own order."""
    mask = np.uint64((1 << max(1, len(x)).bit_length()) - 1)
    return (np.sort((x & ~mask) | np.arange(len(x), dtype=np.uint64)) & mask).astype(np.int64)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the row before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def tally(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and how often each occurs or the sum of its n."""
    ordered = np.sort(keys)
    at = np.flatnonzero(_changes(ordered))
    known = ordered[at]
    count = np.diff(np.append(at, len(ordered)))
    if n is not None and len(more := np.flatnonzero(n > 1)):
        np.add.at(count, np.searchsorted(known, keys[more]), n[more].astype(np.int64) - 1)
    return known, count


def count_rows(columns: list[np.ndarray], bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows of uint64 columns of numbers under 2^bits, in order, and how often each occurs."""
    fit = 64 // bits
    packed = columns[0]
    for c in columns[1:fit]:
        packed = (packed << np.uint64(bits)) | c
    first = min(fit, len(columns))

    def apart(x: np.ndarray) -> list[np.ndarray]:
        return [(x >> np.uint64(bits * k)) & np.uint64((1 << bits) - 1) for k in range(first - 1, -1, -1)]

    if len(columns) <= fit:
        known, count = tally(packed)
        return apart(known), count
    known, place = np.unique(packed, return_inverse=True)
    (rank, *rest), count = count_rows([place.astype(np.uint64), *columns[fit:]], max(bits, len(known).bit_length()))
    return [*apart(known[rank.astype(np.int64)]), *rest], count


# Rows between tasks: a shard and a block of rows, columns of ids with a count, by byte planes, which compress well.


def pack_rows(columns: list[np.ndarray], n: np.ndarray) -> bytes:
    big = n[n >= MANY].astype("<u8")
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(n), -1).T.tobytes() for c in columns]
    raw = b"".join([*planes, np.minimum(n, MANY).astype(np.uint8).tobytes(), big.tobytes()])
    head = struct.pack("<QQQBB", len(raw), len(n), len(big), len(columns), columns[0].dtype.itemsize)
    return head + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack_rows(data: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    size, rows, more, columns, width = struct.unpack_from("<QQQBB", data)
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[26:], size, asbytes=True), np.uint8)
    found = [np.ascontiguousarray(raw[k * rows * width :][: rows * width].reshape(width, rows).T).view(f"<u{width}").ravel() for k in range(columns)]
    n = raw[columns * rows * width :][:rows].astype(np.int64)
    if more:
        n[n == MANY] = np.frombuffer(raw[(columns * width + 1) * rows :].tobytes(), "<u8")
    return found, n


ROWS = pa.schema([("shard", pa.int32()), ("slot", pa.int32()), ("data", pa.binary())])
SHAPE = "shard int, slot int, data binary"
TOLD = -1  # the shard of what is told of finished shards, by level


@lru_cache(maxsize=8)
def slots(parts: int) -> np.ndarray:
    """Numbers of which each is dealt to a partition of its own by a hash partitioning into ``parts`` (murmur3 with the seed 42, as Spark has it), so that
    each task gets one shard; by another hash some tasks would get several."""
    found = np.full(parts, -1, np.int64)
    at, step = 0, 16 * parts + 1024
    turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    while (found < 0).any():
        keys = np.arange(at, at + step, dtype=np.uint32)
        h = turn(np.uint32(42) ^ (turn(keys * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        for shift, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            h = (h ^ (h >> np.uint32(shift))) * np.uint32(times)
        part = h.view(np.int32).astype(np.int64) % parts
        found[part[::-1]] = keys[::-1]
        at += step
    return found


def _by_shard(columns: list[np.ndarray], n: np.ndarray, shard: np.ndarray, parts: int):
    """Batches of packed rows, those of each of ``parts`` shards in their order."""
    if not len(n):
        return
    ascending = not (shard[1:] < shard[:-1]).any()
    if not ascending:
        order = np.argsort(shard.astype(np.uint16) if shard.max() < 1 << 16 else shard, kind="stable")
        shard, columns, n = shard[order], [c[order] for c in columns], n[order]
    cuts = np.append(np.flatnonzero(_changes(shard)), len(shard))
    for a, b in zip(cuts, cuts[1:]):
        told = [pa.array([shard[a]], pa.int32()), pa.array([slots(parts)[shard[a]]], pa.int32()), pa.array([pack_rows([c[a:b] for c in columns], n[a:b])], pa.binary())]
        yield pa.RecordBatch.from_arrays(told, schema=ROWS)


def _told(told: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([TOLD], pa.int32()), pa.array([0], pa.int32()), pa.array([json.dumps(told).encode()], pa.binary())], schema=ROWS)


def _add_told(sums: dict, more: dict) -> None:
    """Adds what is told by level: counts of counts, and the finished shards."""
    for level, x in more.items():
        own = sums.setdefault(level, {"n": [0] * 5, "done": []})
        own["n"] = [a + b for a, b in zip(own["n"], x["n"])]
        own["done"] += x["done"]


def _counts_of_counts(n: np.ndarray) -> list[int]:
    """How many of n are 1, 2, 3 and 4, and how many are over 2."""
    found = np.bincount(np.minimum(n, 5), minlength=6).tolist()
    return [*found[1:5], sum(found[3:])]


@dataclass
class Model:
    """What a worker needs besides the files."""

    folder: str
    order: int
    bits: int  # leading bits of a hash that name its vocabulary shard
    starts: list[int] = field(default_factory=list)  # first id of each vocabulary shard
    shards: int = 1
    train_tokens: int = 0
    written: dict[int, frozenset[int]] = field(default_factory=dict)  # by level, the shards that have n-grams
    discounts: dict[int, list[float]] = field(default_factory=dict)  # by level, D for the counts 0, 1, 2, 3 and more
    floor: float = 1.0  # the lowest level's weight of 1 / (V + 1)
    total: int = 0  # the lowest level's counts together
    wide: bool = False  # ids of 64 bits, also where 32 hold them

    @property
    def size(self) -> int:
        return self.starts[-1]

    @property
    def start(self) -> int:
        """The id of the start symbol; that of a token not in training follows."""
        return self.size

    @property
    def kind(self) -> type:
        """Ids have 32 bits, as long as these hold them all."""
        return np.uint32 if self.size + 1 < 1 << 32 and not self.wide else np.uint64


def _leading(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def vocabulary(model: Model, arrays: Arrays, hashes: np.ndarray, *names: str) -> list[np.ndarray]:
    """For hashes in about ascending order the ids, then their values in the arrays ``names``, 0 for tokens that are not known."""
    found = [np.full(len(hashes), model.size + 1, np.uint64), *(np.zeros(len(hashes), np.int64) for _ in names)]
    shard = _leading(hashes, model.bits)
    cuts = np.append(np.flatnonzero(_changes(shard)), len(shard))
    for a, b in zip(cuts, cuts[1:]):
        s = int(shard[a])
        if model.starts[s] == model.starts[s + 1]:
            continue
        known = arrays[f"vocabulary-{s}"]["hash"]
        where = np.minimum(np.searchsorted(known, hashes[a:b]), len(known) - 1)
        hit = np.flatnonzero(known[where] == hashes[a:b])
        where = where[hit]
        found[0][a + hit] = where + model.starts[s]
        for out, name in zip(found[1:], names):
            out[a + hit] = arrays[f"{name}-{s}"]["n"][where]
    return found


def context_key(ids: list[np.ndarray]) -> np.ndarray:
    """The key of a context, its tokens in the order of the text."""
    key = mix64(ids[-1].astype(np.uint64))
    for size, before in enumerate(ids[-2::-1], 2):
        key = mix64(key * STEP + mix64(before.astype(np.uint64) + np.uint64(size << 48)))
    return key


def contexts(ids: np.ndarray, of: np.ndarray, order: int, start: int) -> list[np.ndarray]:
    """For each token the ids of the tokens order - 1, ..., 2, 1 places before it."""
    place = np.arange(len(ids)) - np.repeat(of[:-1], np.diff(of))
    found = []
    for back in range(order - 1, 0, -1):
        before = np.full(len(ids), start, np.uint64)
        before[back:] = ids[:-back] if back < len(ids) else ids[:0]
        found.append(np.where(place >= back, before, np.uint64(start)))
    return found


def event_key(context: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return mix64(context * STEP + ids.astype(np.uint64) * SALT)


def shard_of(context: np.ndarray, shards: int) -> np.ndarray:
    """Ascending with the context's key."""
    return (((context >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


# Sorted hash arrays.


def hash_array(name: str, keys: np.ndarray, shift: int) -> dict[str, np.ndarray]:
    """Of keys in order of their buckets: the first place of each bucket, and of each key the 32 bits that follow those of its bucket."""
    bounds = np.arange(1, 1 << (64 - shift), dtype=np.uint64) << np.uint64(shift)
    heads = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]]).astype(np.uint32)
    return {f"{name}_heads": heads, f"{name}_keys": (keys >> np.uint64(shift - 32)).astype(np.uint32)}


def bucket_shift(n: int) -> int:
    """64 less the bits of a bucket's number, so that a bucket holds about eight to sixteen of n keys."""
    return 64 - min(24, max(1, (n // 8).bit_length() - 1))


def find(table: dict[str, np.ndarray], name: str, keys: np.ndarray) -> np.ndarray:
    """The place of each key, -1 where it is not."""
    heads, known = table[f"{name}_heads"], table[f"{name}_keys"]
    shift = 64 - (len(heads) - 1).bit_length() + 1
    bucket = (keys >> np.uint64(shift)).astype(np.int64)
    want = (keys >> np.uint64(shift - 32)).astype(np.uint32)
    at, end = heads[bucket].astype(np.int64), heads[bucket + 1].astype(np.int64)
    out = np.full(len(keys), -1, np.int64)
    rows = np.flatnonzero(at < end)
    at, end, want = at[rows], end[rows], want[rows]
    while len(rows):
        hit = known[at] == want
        out[rows[hit]] = at[hit]
        at += 1
        on = np.flatnonzero(~hit & (at < end))
        rows, at, end, want = rows[on], at[on], end[on], want[on]
    return out


def gram_table(keys: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Counts stand in the low byte of a key while it is sorted, below the bits that are used."""
    low = np.uint64(0xFF)
    packed = np.sort((keys & ~low) | np.minimum(n, MANY).astype(np.uint64))
    many = np.flatnonzero(n >= MANY)
    many = many[np.argsort(keys[many])]
    return hash_array("gram", packed, bucket_shift(len(packed))) | {"count": (packed & low).astype(np.uint8), "many_keys": keys[many], "many": n[many].astype(np.uint64)}


def context_table(keys: np.ndarray, stats: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics are few different rows, so each context has the place of its own among them; the first is that of a context seen once."""
    once = stats[:, 0] == 1
    other = stats[~once]
    key = np.zeros(len(other), np.uint64)
    for c in other.T:
        key = mix64(key * STEP + c.astype(np.uint64))
    _, first, place = np.unique(key, return_index=True, return_inverse=True)
    table = np.concatenate([np.array([[1, 1, 0, 0]], np.int64), other[first]])
    code = np.zeros(len(keys), np.uint16 if len(table) <= 1 << 16 else np.uint32)
    code[~once] = place + 1
    keys = mix64(keys ^ SALT)
    order = rough_order(keys)
    return hash_array("context", keys[order], bucket_shift(len(keys))) | {"code": code[order], "stats": table.ravel()}


def _smallest(n: np.ndarray) -> np.ndarray:
    return n.astype(np.min_scalar_type(int(n.max(initial=0))))


# Counting.


def _count_vocabulary(bits: int):
    def run(batches):
        held, size = [], 0

        def flush():
            known, n = tally(np.concatenate(held))
            return _by_shard([known], n, _leading(known, bits), 1 << bits)

        for batch in batches:
            for _, part in pieces(batch.column("text")):
                held.append(tokens(part)[0])
                size += len(held[-1])
                if size >= HELD:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return run


def _blocks(table: pa.Table):
    """The rows of a shard, by parts of at least HELD rows."""
    waiting, size = [], 0
    for data in table.column("data"):
        waiting.append(unpack_rows(data.as_py()))
        size += len(waiting[-1][1])
        if size >= HELD:
            yield [np.concatenate(c) for c in zip(*(x for x, _ in waiting))], np.concatenate([n for _, n in waiting])
            waiting, size = [], 0
    if waiting:
        yield [np.concatenate(c) for c in zip(*(x for x, _ in waiting))], np.concatenate([n for _, n in waiting])


def _write_vocabulary(folder: str):
    def run(batches):
        for (shard,), table in runs(batches, ["shard"]):
            known, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            for (h,), more in _blocks(table):
                known, n = tally(np.concatenate([known, h]), np.concatenate([n, more]))
            write_arrays(folder, f"vocabulary-{shard}", {"hash": known})
            write_arrays(folder, f"raw-{shard}", {"n": _smallest(n)})
            yield pa.RecordBatch.from_pydict({"shard": [int(shard)], "size": [len(n)], "tokens": [int(n.sum())]}, schema=pa.schema([("shard", pa.int32()), ("size", pa.int64()), ("tokens", pa.int64())]))

    return run


def _count_ngrams(model: Model):
    def run(batches):
        arrays = Arrays.of(model.folder)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            # ids of this flush, in the order of those of the vocabulary; the start symbol is the last
            parts, base = [], 0
            known, place = np.unique(np.concatenate([x for x, _, _ in held]), return_inverse=True)
            for x, back, _ in held:
                parts.append(place[base : base + len(x)][back])
                base += len(x)
            ids = np.concatenate(parts).astype(np.uint64)
            of = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(of) for _, _, of in held]))])
            (told,) = vocabulary(model, arrays, known)
            told = np.append(told, np.uint64(model.start)).astype(model.kind)
            grams, n = count_rows([*contexts(ids, of, model.order, len(known)), ids], len(known).bit_length())
            grams = [told[g.astype(np.int64)] for g in grams]
            return _by_shard(grams, n, _shards(grams[:-1], model.shards), model.shards)

        for batch in batches:
            for _, part in pieces(batch.column("text")):
                h, of = tokens(part)
                order = rough_order(h)
                new = _changes(h[order])
                back = np.empty(len(h), np.int64)
                back[order] = np.cumsum(new) - 1
                held.append((h[order][new], back, of))
                size += len(h)
                if size >= HELD:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return run


def _shards(context: list[np.ndarray], shards: int) -> np.ndarray:
    """The shard of each row, worked out once for rows of one context in a row."""
    head = np.flatnonzero(_changes(*context))
    return np.repeat(shard_of(context_key([c[head] for c in context]), shards), np.diff(np.append(head, len(context[0]))))


def _ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The numbers as they are if they have 32 bits, else their ranks, and what the ranks stand for."""
    if x.dtype == np.uint32:
        return x.astype(np.uint64), None
    known, place = np.unique(x, return_inverse=True)
    return place.astype(np.uint64), known


def _named(x: np.ndarray, known: np.ndarray | None) -> np.ndarray:
    return x.astype(np.uint32) if known is None else known[x.astype(np.int64)]


def add_up(columns: list[np.ndarray], n: np.ndarray | None):
    """(keys of the different contexts in order, their columns, of each different n-gram the place of its context and its token, sums of n)."""
    head = np.flatnonzero(_changes(*columns[:-1]))
    keys, first, place = np.unique(context_key([c[head] for c in columns[:-1]]), return_index=True, return_inverse=True)
    token, names = _ranked(columns[-1])
    context = np.repeat(place.astype(np.uint64), np.diff(np.append(head, len(token))))
    known, count = tally((context << np.uint64(32)) | token, n)
    return keys, [c[head[first]] for c in columns[:-1]], (known >> np.uint64(32)).astype(np.int64), _named(known & np.uint64((1 << 32) - 1), names), count


def _write_level(model: Model, level: int):
    """Writes the shards of a level from 2 on; gives the rows of the level below, with 1 for each left neighbour."""

    def run(batches):
        sums: dict = {}
        starts = np.array(model.starts, np.int64)
        for (shard,), table in runs(batches, ["shard"]):
            if shard == TOLD:
                for data in table.column("data"):
                    _add_told(sums, json.loads(data.as_py()))
                continue
            rows = None
            for columns, n in _blocks(table):
                if rows is not None:
                    columns, n = [np.concatenate(x) for x in zip(rows[0], columns)], np.concatenate([rows[1], n])
                keys, context, place, token, count = add_up(columns, n)
                rows = [*(c[place] for c in context), token], count
            del columns, n, rows
            head = np.searchsorted(place, np.arange(len(keys)))
            stats = np.stack([np.add.reduceat(x, head) for x in (count, (count == 1).astype(np.int64), (count == 2).astype(np.int64), (count > 2).astype(np.int64))], axis=1)
            write_arrays(model.folder, f"level{level}-{shard}", gram_table(event_key(keys[place], token), count) | context_table(keys, stats))
            _add_told(sums, {str(level): {"n": _counts_of_counts(count), "done": [int(shard)]}})
            del stats, head
            if level == 2:
                low, n = tally(token)
                yield from _by_shard([low], n, np.searchsorted(starts, low.astype(np.int64), "right") - 1, 1 << model.bits)
                continue
            below = context[1:]
            if level == 3:
                rank, names = _ranked(below[0])
                low, n = tally((rank[place] << np.uint64(32)) | _ranked(token)[0])
                columns = [_named(low >> np.uint64(32), names)]
            else:
                _, first, rank = np.unique(context_key(below), return_index=True, return_inverse=True)
                low, n = tally((rank.astype(np.uint64)[place] << np.uint64(32)) | _ranked(token)[0])
                columns = [c[first[(low >> np.uint64(32)).astype(np.int64)]] for c in below]
            columns.append(_named(low & np.uint64((1 << 32) - 1), _ranked(token)[1]))
            yield from _by_shard(columns, n, _shards(columns[:-1], model.shards), model.shards)
        if sums:
            yield _told(sums)

    return run


def _write_lowest(model: Model):
    def run(batches):
        sums: dict = {}
        total = 0
        for (shard,), table in runs(batches, ["shard"]):
            if shard == TOLD:
                for data in table.column("data"):
                    _add_told(sums, json.loads(data.as_py()))
                continue
            n = np.zeros(model.starts[shard + 1] - model.starts[shard], np.int64)
            for (token,), more in _blocks(table):
                np.add.at(n, token.astype(np.int64) - model.starts[shard], more)
            write_arrays(model.folder, f"lowest-{shard}", {"n": _smallest(n)})
            _add_told(sums, {"1": {"n": _counts_of_counts(n), "done": [int(shard)]}})
            total += int(n.sum())
        yield pa.RecordBatch.from_pydict({"told": [json.dumps(sums)], "total": [total]})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Chen and Goodman's D for the counts 0, 1, 2, and 3 and more, kept within 0 and the count; 0.5 where counts are missing."""
    if not n1 or not n2:
        return [0.0, 0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2 - 3 * y * n3 / n2]
    return [0.0, *(min(max(x, 0.01), k - 0.01) for k, x in zip((1, 2, 3), d))]


def fit(docs: DataFrame, text_col: str = "text", order: int = 3, wide: bool = False) -> Model:
    """Counts the texts of ``docs`` and writes a model of the given order, 2 or more. Null text is empty; very long texts are read whole. Ids have 32
    bits as long as these hold them all, and 64 else or if ``wide``; the model is the same."""
    if order < 2:
        raise ValueError("an order of 2 or more")
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(text_col).alias("text"))
    bits = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    model = Model(new_path(spark, "lm"), order, bits, wide=wide)
    dealt = lambda rows, parts: rows.repartition(parts, "slot").sortWithinPartitions("shard")
    counted = dealt(texts.mapInArrow(_count_vocabulary(bits), SHAPE), 1 << bits).mapInArrow(_write_vocabulary(model.folder), "shard int, size long, tokens long")
    with brief_shuffles(spark):
        sizes = {r["shard"]: r for r in counted.collect()}
    model.starts = [0]
    for s in range(1 << bits):
        model.starts.append(model.starts[-1] + (sizes[s]["size"] if s in sizes else 0))
    model.train_tokens = sum(r["tokens"] for r in sizes.values())
    model.shards = max(1, -(-model.train_tokens // SHARD_TOKENS), min(1 << bits, -(-model.train_tokens // 100_000)))
    rows = texts.mapInArrow(_count_ngrams(model), SHAPE)
    for level in range(order, 1, -1):
        rows = dealt(rows, model.shards).mapInArrow(_write_level(model, level), SHAPE)
    sums: dict = {}
    with brief_shuffles(spark):
        told = dealt(rows, 1 << bits).mapInArrow(_write_lowest(model), "told string, total long").collect()
    for r in told:
        _add_told(sums, json.loads(r["told"]))
        model.total += r["total"]
    for level in range(1, order + 1):
        n = sums.get(str(level), {"n": [0] * 5, "done": []})
        model.discounts[level] = discounts(*n["n"][:4])
        model.written[level] = frozenset(n["done"])
    if model.total:
        d, n = model.discounts[1], sums["1"]["n"]
        model.floor = (d[1] * n[0] + d[2] * n[1] + d[3] * n[4]) / model.total
    return model


def delete_model(spark: SparkSession, model: Model) -> None:
    delete(spark, model.folder)


def level_scores(model: Model, arrays: Arrays, level: int, context: np.ndarray, ids: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The probabilities ``p`` of tokens by a level lower, interpolated with this level's."""
    order = rough_order(context)
    context = context[order]
    new = _changes(context)
    head = np.flatnonzero(new)
    keys = context[head]
    shard = shard_of(keys, model.shards)
    stats = np.zeros((len(head), 4), np.int64)
    count = np.zeros(len(order), np.int64)
    run = np.cumsum(new) - 1
    token = ids[order]
    cuts = np.append(np.flatnonzero(_changes(shard)), len(shard))
    ends = np.append(head, len(order))
    for a, b in zip(cuts, cuts[1:]):
        s = int(shard[a])
        if s not in model.written[level]:
            continue
        table = arrays[f"level{level}-{s}"]
        place = find(table, "context", mix64(keys[a:b] ^ SALT))
        seen = np.flatnonzero(place >= 0)
        stats[a + seen] = table["stats"].reshape(-1, 4)[table["code"][place[seen]]]
        rows = np.arange(ends[a], ends[b])
        rows = rows[(stats[run[rows], 0] > 0) & (token[rows] < model.size)]
        key = event_key(context[rows], token[rows])
        place = find(table, "gram", key)
        known = np.flatnonzero(place >= 0)
        n = table["count"][place[known]].astype(np.int64)
        if len(many := np.flatnonzero(n == MANY)):
            n[many] = table["many"][np.minimum(np.searchsorted(table["many_keys"], key[known[many]]), len(table["many"]) - 1)]
        count[rows[known]] = n
    d = np.array(model.discounts[level])
    total = np.maximum(stats[:, 0], 1)
    back = np.where(stats[:, 0] > 0, (stats[:, 1:] @ d[1:]) / total, 1.0)
    out = np.empty(len(order))
    out[order] = np.maximum(count - d[np.minimum(count, 3)], 0.0) / total[run] + back[run] * p[order]
    return out


def token_scores(model: Model, arrays: Arrays, h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(occurrences in training, whether there are any, probability) of each token."""
    order = rough_order(h)
    new = _changes(h[order])
    back = np.empty(len(h), np.int64)
    back[order] = np.cumsum(new) - 1
    ids, raw, n = vocabulary(model, arrays, h[order][new], "raw", "lowest")
    d = np.array(model.discounts[1])
    p = (np.maximum(n - d[np.minimum(n, 3)], 0.0) / max(model.total, 1) + model.floor / (model.size + 1))[back]
    ids = ids[back]
    before = contexts(ids, of, model.order, model.start)
    for level in range(2, model.order + 1):
        p = level_scores(model, arrays, level, context_key(before[model.order - level :]), ids, p)
    return raw[back], ids < model.size, p


def _score(model: Model):
    size, total = model.size, model.train_tokens
    most = min(max(2 << 20, model.shards << 13), 8 << 20)  # with many shards more tokens at once, as each shard's part is looked up apart

    def run(batches):
        arrays = Arrays.of(model.folder)
        for batch in batches:
            for first, part in pieces(batch.column("text"), most):
                h, of = tokens(part)
                raw, known, p = token_scores(model, arrays, h, of)
                base = np.log10((raw + 0.5) / (total + 0.5 * (size + 1)))
                sums = lambda x: np.add.reduceat(x, of[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(first, len(part)), pa.array(np.diff(of).astype(np.int64)), pa.array(sums(known.astype(np.int64))), pa.array(np.full(len(part), total, np.int64)), pa.array(sums(base)), pa.array(sums(np.log10(p)))],
                    names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, n_known, train_tokens, base_score (add-half unigrams) and score, both log10 of the text's probability.

    Defined cases: null and empty texts are the end token alone; a very long text is one pass, whole; rows with null or repeated ids are rows
    like any others; with an empty training corpus every token is unknown, with probability 1; an empty table gives an empty result; extra
    columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_score(model), f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", id_col)
