"""Byte-level BPE encoding and decoding (operator 3).

``merge`` applies merges through a rank queue: one bucket per merge rank holds the positions of the linked list of
parts at which that merge can be made; a bitmap of two levels over the ranks finds the least one by find-first-set, in the upper level
the first word with a bucket and in that word the first bucket; an entry whose parts have changed since is stale and skipped. Each merge makes at most
two new entries, so n bytes take O(n) queue steps, also where a pre-token is very long. Many short pre-tokens share one
list and one queue, with no pairs across their ends, so that a bucket is found once for all of them.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._store import small_batches

#: Pre-tokens of at most so many characters are looked up in, and added to, a worker's memo of at most MEMO entries.
MEMO_CHARS, MEMO = 64, 1_000_000
#: Texts whose new pre-tokens are merged together, and pre-tokens in one queue.
TEXTS, TOGETHER = 64, 2000
#: Ranks in a word of the lower bitmap, as a power of two.
BITS = 8
SHIFT = 32


class ByteBPE:
    """Encoder and decoder for a vocabulary of ranks (bytes -> rank), as tiktoken files hold it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.size = max(ranks.values(), default=0) + 1
        self.bytes = {v: k for k, v in ranks.items()}
        # \\s of the pattern is the Unicode property; the regex module's \\s also has \\x1c-\\x1f
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.words = [0] * ((self.size >> BITS) + 1)  # the lower bitmap, all 0 between two merges
        self.sizes = [len(self.bytes.get(x, b"")) for x in range(self.size)]
        self.single = [ranks.get(bytes([c]), -1) for c in range(256)]
        #: the rank of what two parts, side by side, make
        self.joins: dict[int, int] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    self.joins[left << SHIFT | right] = rank

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(a): int(b) for a, b in pairs}, pattern)

    def merge(self, tokens: list[bytes]) -> list[list[int]]:
        """The ids of each pre-token; one that is in the vocabulary is its own id."""
        data = b"".join(tokens)
        n = len(data)
        part = [self.single[c] for c in data]
        part.append(-1)
        end = list(range(1, n + 2))  # of the part that starts at a position
        before = list(range(-1, n + 1))  # start of the part before; -1 at the first part of a pre-token, -2 where no part starts
        at = 0
        for token in tokens:
            before[at] = -1
            at += len(token)
        before[n] = -1
        words, sizes, find, mask = self.words, self.sizes, self.joins.get, (1 << BITS) - 1
        buckets: dict[int, list[int]] = {}
        upper = 0
        for i in range(n - 1):
            if before[i + 1] >= 0 and (new := find(part[i] << SHIFT | part[i + 1])) is not None:
                if new in buckets:
                    buckets[new].append(i)
                else:
                    buckets[new] = [i]
                    words[new >> BITS] |= 1 << (new & mask)
                    upper |= 1 << (new >> BITS)
        while upper:
            word = (upper & -upper).bit_length() - 1
            bits = words[word]
            low = bits & -bits
            rank = least = word << BITS | low.bit_length() - 1
            entries = buckets.pop(rank)
            words[word] = bits ^ low
            if bits == low:
                upper ^= 1 << word
            entries.sort()
            size = sizes[rank]
            for i in entries:
                middle = end[i]
                if before[middle] != i or (stop := end[middle]) - i != size:
                    continue  # stale
                end[i] = stop
                part[i] = rank
                before[middle] = -2
                if before[stop] >= 0:
                    before[stop] = i
                    if (new := find(rank << SHIFT | part[stop])) is not None:
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            buckets[new] = [i]
                            words[new >> BITS] |= 1 << (new & mask)
                            upper |= 1 << (new >> BITS)
                            least = min(least, new)
                if (prev := before[i]) >= 0 and (new := find(part[prev] << SHIFT | rank)) is not None:
                    if new in buckets:
                        buckets[new].append(prev)
                    else:
                        buckets[new] = [prev]
                        words[new >> BITS] |= 1 << (new & mask)
                        upper |= 1 << (new >> BITS)
                        least = min(least, new)
                if least < rank:  # a pair of lower rank has come up and goes first
                    if rest := entries[bisect_right(entries, i) :]:
                        buckets[rank] = rest
                        words[word] |= low
                        upper |= 1 << word
                    break
        out, at = [], 0
        for token in tokens:
            ids, i, at = [], at, at + len(token)
            if (whole := self.ranks.get(token)) is not None:
                ids, i = [whole], at
            while i < at:
                ids.append(part[i])
                i = end[i]
            out.append(ids)
        return out

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def encode(self, text: str) -> list[int]:
        return [x for ids in self.merge([piece.encode() for piece in self.split(text)]) for x in ids]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def encode_documents(
    docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", output: str = "ids",
) -> DataFrame:
    """Each row's id with its token ids (``output="ids"``: n_tokens, ids array<int>, decoded binary) or their digests
    (``output="digest"``: n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256 of the decoded bytes).

    ``vocabulary`` is a file of ranks at the same path on every worker; ``pattern`` splits a text into pre-tokens.
    Defined cases: null and empty texts have no tokens; rows with null or repeated ids are rows like any others; texts are never cut;
    an empty table gives an empty result; extra columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    if output == "digest":
        return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(_digests(vocabulary, pattern), f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(_ids(vocabulary, pattern), f"{id_col} {kind}, n_tokens long, ids array<int>, decoded binary")


class Memo:
    """What a worker keeps of pre-tokens that it has merged, for later texts and tasks: an entry for the ids and the decoded bytes of each."""

    known: dict[tuple[str, str, bool], Memo] = {}

    def __init__(self, vocabulary: str, pattern: str, digest: bool):
        self.bpe = ByteBPE.from_file(vocabulary, pattern)
        self.digest = digest
        self.ids: dict[str, str | list[int]] = {}
        self.raw: dict[str, bytes] = {}

    @classmethod
    def of(cls, vocabulary: str, pattern: str, digest: bool) -> Memo:
        key = (vocabulary, pattern, digest)
        if key not in cls.known:
            cls.known[key] = cls(vocabulary, pattern, digest)
        return cls.known[key]

    def learn(self, tokens: set[str]) -> None:
        if len(self.ids) > MEMO:
            self.ids.clear()
            self.raw.clear()
        new = list(tokens.difference(self.ids))
        for at in range(0, len(new), TOGETHER):
            some = new[at : at + TOGETHER]
            for token, ids in zip(some, self.bpe.merge([x.encode() for x in some])):
                self.ids[token] = "".join([f",{x}" for x in ids]) if self.digest else ids
                self.raw[token] = self.bpe.decode(ids)

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[list, bytes]]:
        """For each text the entries of its pre-tokens in order and all decoded bytes. A digest's entry is each id as text after a comma."""
        split = [self.bpe.split(x or "") for x in texts]
        every = set().union(*split)
        self.learn(every)
        for tokens in split:
            yield list(map(self.ids.__getitem__, tokens)), b"".join(map(self.raw.__getitem__, tokens))
        for token in every:
            if len(token) > MEMO_CHARS:
                del self.ids[token], self.raw[token]


def _digests(vocabulary: str, pattern: str):
    def run(batches):
        memo = Memo.of(vocabulary, pattern, True)
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for batch in batches:
            counts, names, decoded = [], [], []
            for at in range(0, batch.num_rows, TEXTS):
                for entries, raw in memo(batch.column(1).slice(at, TEXTS).to_pylist()):
                    ids = "".join(entries)
                    counts.append(ids.count(","))
                    names.append(sha(ids[1:].encode()))
                    decoded.append(sha(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(names, pa.string()), pa.array(decoded, pa.string())], names=[batch.schema.names[0], "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(vocabulary: str, pattern: str):
    def run(batches):
        memo = Memo.of(vocabulary, pattern, False)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                ids, decoded = [], []
                for entries, raw in memo(part.column(1).to_pylist()):
                    ids.append([x for e in entries for x in e])
                    decoded.append(raw)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, ids)), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())], names=[batch.schema.names[0], "n_tokens", "ids", "decoded"])

    return run
