"""Alignment of the tokens of two tokenizers over the same bytes (operator 11).

The tokens of B are a static index of intervals: both ends ascend, so the intervals that a token of A overlaps are found by two
bisections. A gap between two tokens of B that no token of A spans is a boundary of both, and the tokens between two
boundaries are a group. A text is cut where both tokenizers must part, before runs of spaces that follow other signs, and each different
stretch is encoded and aligned once in a worker. How often two tokens end together in the corpus is counted in two steps: numbers of a block of texts first, then
those of all blocks; the sums come back to each block as one array.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._store import Kept, small_batches
from tessera.llm._text import pieces, utf8

#: A block of texts ends after so many stretches, or so many different ones.
BLOCK_STRETCHES, BLOCK_DIFFERENT = 1 << 21, 1 << 18
#: Different stretches that a worker keeps between blocks; longer stretches than LONG bytes are not kept.
KEPT, LONG = 600_000, 256
#: Values in one row of a table between the two steps.
ROW = 1 << 14
_SPACE, _META = 0x20, "▁"
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True
_LEAD = np.zeros(256, bool)  # first bytes of characters among which there is white space
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_ENDS = frozenset(np.flatnonzero(_WHITE).tolist())
_WIDE = frozenset(bytes([b]) for b in np.flatnonzero(_LEAD).tolist())


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE of a tokenizer file. Where merges are in the order of the ids they give, as of a vocabulary of ranks, the faster encoder of ranks gives the same
    ids; other files go through the tokenizer itself."""

    def __init__(self, path: str, pattern: str | None = None):
        from tokenizers import Tokenizer

        told = json.load(open(path, encoding="utf-8"))
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = byte_alphabet()
        special = {t["content"] for t in told.get("added_tokens", [])}
        vocabulary = told["model"]["vocab"]
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.tokens = [b""] * size
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.tokens[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.ranks = None
        cut, merges = told.get("pre_tokenizer") or {}, [m if isinstance(m, list) else m.split(" ") for m in told["model"].get("merges", [])]
        made = [vocabulary[a + b] for a, b in merges]
        plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and told.get("normalizer") is None
        if pattern and plain and made == sorted(set(made)) and not told["model"].get("ignore_merges") and len(merges) + 256 == len([t for t in vocabulary if t not in special]):
            import tiktoken

            ranks = {self.tokens[i]: i for t, i in vocabulary.items() if t not in special}
            self.ranks = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        return self.ranks.encode_ordinary(text) if self.ranks is not None else self.tokenizer.encode(text, add_special_tokens=False).ids


class Pieces:
    """A sentence-piece model whose pieces have the mark of spaces at their start only, so that no piece reaches over the start of a run of spaces.

    Stretches begin with a space. They are encoded behind a letter, whose own ids are cut off, so their spaces are inner ones.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.tokens: list[bytes] = []
        self.parts = True
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.parts &= _META not in piece.lstrip(_META)
            self.tokens.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(_META, " ").encode())
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.before = len(self.model.encode("a"))

    def __call__(self, text: str) -> list[int]:
        return self.model.encode("a" + text)[self.before :] if self.parts else self.model.encode(text[1:])


def encode(side: ByteLevel | Pieces, stretches: list[bytes], parts: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, how many each stretch has, whether they give its bytes). Stretches that may stand before others (``parts``) are encoded many at once, as the tokenizer parts them
    again; where the bytes differ, and other stretches, one by one."""
    n = len(stretches)
    found: list[np.ndarray] = [None] * n
    good = np.ones(n, bool)
    open_ = [i for i, s in enumerate(stretches) if not (parts and s[-1] not in _ENDS and s[-2:-1] not in _WIDE and s[-3:-2] not in _WIDE)]
    rest = sorted(set(range(n)) - set(open_))
    for k in range(0, len(rest), 4096):
        part = rest[k : k + 4096]
        joined = b"".join([stretches[i] for i in part])
        ids = np.array(side(joined.decode()), np.int64)
        ends, wanted = np.cumsum(side.sizes[ids]), np.cumsum([len(stretches[i]) for i in part])
        at = np.searchsorted(ends, wanted)
        if b"".join([side.tokens[i] for i in ids.tolist()]) != joined or not np.array_equal(ends[np.minimum(at, len(ends) - 1)], wanted):
            open_ += part
            continue
        cuts = [0, *(at + 1).tolist()]
        for i, a, b in zip(part, cuts, cuts[1:]):
            found[i] = ids[a:b]
    for i in open_:
        found[i] = np.array(side(stretches[i].decode()), np.int64)
        good[i] = b"".join([side.tokens[t] for t in found[i].tolist()]) == stretches[i]
    return np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64), np.array([len(x) for x in found], np.int64), good


def overlaps(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) of the intervals of B that overlap each of A: by bisection, as neither A's nor B's intervals overlap among themselves."""
    return np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")


def boundaries(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Which of n intervals of B end where no interval of A goes on: ``first`` and ``last`` span the gaps first .. last - 2."""
    spans = np.zeros(n + 1, np.int64)
    wide = last - first > 1
    np.add.at(spans, first[wide], 1)
    np.add.at(spans, last[wide] - 1, -1)
    return np.cumsum(spans)[:n] == 0


def _digits(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits in seven columns, set to the right, and which of them count."""
    tens = 10 ** np.arange(6, -1, -1)
    told = ids[:, None] // tens
    return (told % 10 + 48).astype(np.uint8), (told > 0) | (tens == 1)


class Aligner:
    """Different stretches with their tokens, groups and links, kept by a worker between tasks."""

    _by_path: dict[tuple, Aligner] = {}

    def __init__(self, a: str, b: str, pattern: str | None):
        self.a, self.b = ByteLevel(a, pattern), Pieces(b)
        self.forget()

    @classmethod
    def of(cls, *key) -> Aligner:
        if key not in cls._by_path:
            cls._by_path[key] = cls(*key)
        return cls._by_path[key]

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.told: list[bytes] = []  # the stretch's groups as text
        self.links: list[np.ndarray] = []  # A id x 2^32 + B id of the tokens that end together
        self.counts: list[tuple[int, int, int, bool]] = []  # tokens of A, tokens of B, groups, whether both give the stretch's bytes

    def learn(self, stretches: list[bytes]) -> None:
        """Encodes and aligns new stretches, all at once."""
        n = len(stretches)
        told = [encode(side, stretches, self.b.parts) for side in (self.a, self.b)]
        good = told[0][2] & told[1][2]
        count = [c for _, c, _ in told]
        flat = [f[np.repeat(good, c)] for f, c, _ in told]
        of = [np.repeat(np.arange(n), np.where(good, c, 0)) for c in count]
        ends = [np.cumsum(side.sizes[f]) for side, f in zip((self.a, self.b), flat)]
        starts = [e - side.sizes[f] for side, f, e in zip((self.a, self.b), flat, ends)]
        first, last = overlaps(starts[0], ends[0], starts[1], ends[1])
        cut = boundaries(first, last, len(flat[1]))  # the ends of stretches too
        closes = ends[1][cut]
        together = last - 1
        linked = ends[1][together] == ends[0] if len(together) else np.zeros(0, bool)
        keys = (flat[0][linked] << 32) | flat[1][together[linked]]
        group = [np.searchsorted(closes, e, "left") for e in ends]
        of_group = of[1][cut]
        sums = [np.concatenate([[0], np.cumsum(np.bincount(g, minlength=len(closes)))]) for g in group]
        place = [np.arange(len(flat[0])) + sums[1][group[0]], np.arange(len(flat[1])) + sums[0][group[1] + 1]]
        total = len(flat[0]) + len(flat[1])
        both, mark, row = np.zeros(total, np.int64), np.full(total, ord(","), np.uint8), np.zeros(total, np.int64)
        for p, f, o in zip(place, flat, of):
            both[p], row[p] = f, o
        mark[place[0][closes[group[0]] == ends[0]]] = ord("|")
        mark[place[1][cut]] = ord(";")
        digits, real = _digits(both)
        text = np.concatenate([digits, mark[:, None]], axis=1)[np.concatenate([real, np.ones((total, 1), bool)], axis=1)]
        size = np.bincount(row, weights=real.sum(axis=1) + 1, minlength=n).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(size)])
        raw = text.tobytes()
        links_at = np.concatenate([[0], np.cumsum(np.bincount(of[0][linked], minlength=n))])
        groups = np.bincount(of_group, minlength=n)
        for i, s in enumerate(stretches):
            self.known[s] = len(self.told)
            self.told.append(raw[at[i] : max(at[i], at[i + 1] - 1)])
            self.links.append(keys[links_at[i] : links_at[i + 1]])
        self.counts += zip(*(c.tolist() for c in (*count, groups, good)))

    def stretches(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of each stretch, offsets of the texts in them) of texts that have a space before them."""
        raw, at = utf8(texts)
        n = len(raw)
        cut = np.zeros(n + 1, bool)
        cut[at] = True
        if self.b.parts and n:
            space = raw == _SPACE
            cut[1:n] |= space[1:] & ~_WHITE[raw[:-1]]
            for back in (2, 3):  # a sign before the space that may itself be white is not parted from it
                cut[back:n] &= ~(space[back:] & _LEAD[raw[: n - back]] & (raw[back - 1 : n - 1] >= 0x80))
            cut[at] = True
        begins = np.flatnonzero(cut).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), max(0, len(begins) - 1), [None, pa.py_buffer(begins), pa.py_buffer(raw.tobytes())])
        coded = words.dictionary_encode()
        different = coded.dictionary.to_pylist()
        new = [s for s in different if s not in self.known]
        if new:
            self.learn(new)
        number = np.array([self.known[s] for s in different], np.int64)
        for s in different:
            if len(s) > LONG:
                del self.known[s]
        return number[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64), np.searchsorted(begins, at)


#: Kinds of rows, in the order in which a block is read: its list of pairs, its stretches, its texts.
PAIRS, STRETCHES, TEXTS = 0, 1, 2
_COLUMNS = {
    "block": pa.int64(), "kind": pa.int32(), "at": pa.int64(), "row": pa.binary(), "pairs": pa.list_(pa.int64()), "times": pa.list_(pa.int64()), "id": pa.int64(),
    "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups": pa.string(),
}
_SPARK = "block long, kind int, at long, row binary, pairs array<long>, times array<long>, id long, n_a long, n_b long, n_groups long, n_links long, groups string"


def _rows(n: int, **told) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(told[c], t) if c in told else pa.nulls(n, t) for c, t in _COLUMNS.items()], names=list(_COLUMNS))


class Block:
    """Texts that are counted together: each different stretch has a number of the block, and how often it occurs in texts that have tokens."""

    def __init__(self, number: int, aligner: Aligner):
        self.number, self.aligner = number, aligner
        self.local = np.full(max(1 << 16, len(aligner.told)), -1, np.int64)
        self.used: list[np.ndarray] = []
        self.times = np.zeros(0, np.int64)
        self.met = 0

    def full(self) -> bool:
        return self.met >= BLOCK_STRETCHES or len(self.times) >= BLOCK_DIFFERENT

    def texts(self, texts: pa.Array, ids: pa.Array, digest: bool) -> pa.RecordBatch:
        n = len(texts)
        told, at = self.aligner.stretches(pa.array([" " + t if t else "" for t in texts.to_pylist()], pa.large_string()))
        if len(self.local) < len(self.aligner.told):
            self.local = np.concatenate([self.local, np.full(2 * len(self.aligner.told) - len(self.local), -1, np.int64)])
        need, nth = np.unique(told, return_inverse=True)
        new = need[self.local[need] < 0]
        self.local[new] = len(self.times) + np.arange(len(new))
        self.used.append(new)
        counts = np.array([(*self.aligner.counts[k], len(self.aligner.links[k])) for k in need.tolist()], np.int64).reshape(-1, 5)
        row = np.repeat(np.arange(n), np.diff(at))
        bad = np.unique(row[counts[nth, 3] == 0])
        some = np.diff(at) > 0
        some[bad] = False
        valid = some[row]
        self.times = np.concatenate([self.times, np.zeros(len(new), np.int64)])
        self.times += np.bincount(self.local[told[valid]], minlength=len(self.times))
        self.met += len(told)
        sums = [np.bincount(row[valid], weights=counts[nth[valid], c], minlength=n).astype(np.int64) for c in (0, 1, 2, 4)]
        numbers = self.local[told].astype("<i4")
        cuts = at.tolist()
        spans = [(a, b) if ok else (a, a) for a, b, ok in zip(cuts, cuts[1:], some.tolist())]
        return _rows(
            n, block=np.full(n, self.number), kind=np.full(n, TEXTS), at=np.zeros(n, np.int64), row=[numbers[a:b].tobytes() for a, b in spans], id=ids,
            n_a=sums[0], n_b=sums[1], n_groups=sums[2], n_links=sums[3], groups=[self._groups(told[a:b].tolist(), digest) for a, b in spans],
        )

    def _groups(self, told: list[int], digest: bool) -> str:
        parts = (b";".join([self.aligner.told[m] for m in told[k : k + (1 << 16)]]) for k in range(0, len(told), 1 << 16))
        if not digest:
            return b";".join(parts).decode()
        state = hashlib.sha256()
        for k, part in enumerate(parts):
            state.update(b";" + part if k else part)
        return state.hexdigest() if told else ""

    def close(self) -> Iterator[pa.RecordBatch]:
        """The block's different pairs with how often each occurs, and the pairs of each stretch as places among them."""
        used = np.concatenate([*self.used, np.zeros(0, np.int64)]).astype(np.int64).tolist()
        links = [self.aligner.links[u] for u in used]
        size = np.array([len(x) for x in links], np.int64)
        pairs, place = np.unique(np.concatenate([*links, np.zeros(0, np.int64)]).astype(np.int64), return_inverse=True)
        count = np.bincount(place, weights=np.repeat(self.times, size), minlength=len(pairs)).astype(np.int64)
        for k in range(0, len(pairs), ROW):
            yield _rows(1, block=[self.number], kind=[PAIRS], at=[k], pairs=[pairs[k : k + ROW]], times=[count[k : k + ROW]])
        at = np.concatenate([[0], np.cumsum(size)])
        for k in range(0, len(used), ROW):
            own = size[k : k + ROW]
            told = own.astype("<i4").tobytes() + place[at[k] : at[k + len(own)]].astype("<i4").tobytes()
            yield _rows(1, block=[self.number], kind=[STRETCHES], at=[k], row=[told], n_a=[len(own)])


def _blocks(a: str, b: str, pattern: str | None, digest: bool):
    def run(batches):
        aligner = Aligner.of(a, b, pattern)
        number = TaskContext.get().partitionId() << 20
        block = Block(number, aligner)
        for batch in batches:
            for first, part in pieces(batch.column("text"), 1 << 21):
                yield block.texts(part, batch.column("id").slice(first, len(part)), digest)
                if block.full():
                    yield from block.close()
                    if len(aligner.told) > KEPT:
                        aligner.forget()
                    number += 1
                    block = Block(number, aligner)
        yield from block.close()

    return run


def _per_stretch(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    at = np.concatenate([[0], np.cumsum(size)])
    return sums[at[1:]] - sums[at[:-1]]


def _sums(batches):
    """A row for each text of sorted rows: the numbers of a block's pairs come first, then the pairs of its stretches, then its texts."""
    now, total, best, size, place, told = None, [], [], [], [], None
    for batch in batches:
        block, kind = (batch.column(c).to_numpy() for c in ("block", "kind"))
        cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)]):
            if a == b:
                continue
            if block[a] != now:
                now, total, best, size, place, told = block[a], [], [], [], [], None
            rows = batch.slice(a, b - a)
            if kind[a] == PAIRS:
                total.append(rows.column("total").to_numpy())
                best.append(rows.column("best").to_numpy(zero_copy_only=False))
            elif kind[a] == STRETCHES:
                for raw, n in zip(rows.column("row").to_pylist(), rows.column("n_a").to_pylist()):
                    own = np.frombuffer(raw, "<i4")
                    size.append(own[:n])
                    place.append(own[n:])
            else:
                if told is None:
                    some, places = np.concatenate([*size, np.zeros(0, "<i4")]), np.concatenate([*place, np.zeros(0, "<i4")])
                    told = [_per_stretch(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)[places], some) for x in (best, total)]
                raw, at = utf8(rows.column("row"))
                numbers, cut = raw.view("<i4"), at // 4
                sums = [_per_stretch(x[numbers], np.diff(cut)) for x in told]
                names = ["n_a", "n_b", "n_groups", "n_links"]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), *(rows.column(c) for c in names), *map(pa.array, sums), rows.column("groups")], names=["id", *names, "n_best", "count_sum", "groups"]
                )


def align_tokens(docs: DataFrame, a: str, b: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row for each text: id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups, the ids of each group as ``a1,a2|b1;a3|b2,b3`` (with
    ``digest`` the SHA-256 of that as groups_sha256).

    ``a`` is a byte-level BPE file that gets a space and the text, ``b`` a sentence-piece model that puts the space itself; strings of special tokens are plain text. ``pattern`` is
    how A cuts texts before merging, if its faster encoder may be used. A link is a pair of tokens that end together; its count is how often the corpus links the two ids,
    n_best counts the links whose count is the highest of their B id. Texts that are null, empty or not given back byte by byte have no tokens: zeros and ''. Rows with null or repeated
    ids are texts of their own, other columns are not read, an empty table gives an empty one. Texts of any length are whole; only the id and a few numbers of a text stand beside
    the numbers of its stretches, and no list is longer than a block.
    """
    kept = Kept(docs.sparkSession)
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = kept.put(rows.mapInArrow(_blocks(a, b, pattern, digest), _SPARK), "alignment-blocks", whole=True)
    lists = rows.where(F.col("kind") == PAIRS).select("block", "at", F.posexplode(F.arrays_zip("pairs", "times")).alias("k", "t"))
    lists = lists.select("block", (F.col("at") + F.col("k")).alias("at"), F.col("t.pairs").alias("pair"), F.col("t.times").alias("n"))
    totals = kept.put(lists.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)), "alignment-pairs")
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    rated = totals.join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups"]
    counted = lists.join(rated, "pair").select("block", F.lit(PAIRS).alias("kind"), "at", "total", "best")
    told = rows.where(F.col("kind") != PAIRS).select("block", "kind", "at", "row", *names).unionByName(counted, allowMissingColumns=True)
    told = told.repartition("block").sortWithinPartitions("block", "kind", "at")
    found = told.mapInArrow(_sums, "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
    return found.withColumnsRenamed({"id": id_col} | ({"groups": "groups_sha256"} if digest else {}))
