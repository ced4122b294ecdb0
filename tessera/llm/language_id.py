"""Language identification by cross-parsing entropy (operator 12).

Of each language a bounded sample of labelled text is kept as a suffix automaton, which tells for any text the longest match
at a place by one transition a byte. A text is parsed greedily into phrases, each the longest match in the language's sample or
a byte that occurs nowhere in it. A phrase is worth log2 of the sample's length in bits (the place it points to), so the
language that explains a text with the fewest bits wins. Automata are dense tables; many stretches of text go through those of all
languages in step, one numpy operation for a byte of each.
"""

from __future__ import annotations

import functools
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._store import small_batches, unused
from tessera.llm._text import pieces, utf8

UNKNOWN = "und"
#: Bytes that one cursor parses; a longer text is parsed in stretches of this size, for every language alike.
STRETCH = 1024
_SPACE = 0x20
_PLAIN = np.full(256, _SPACE, np.uint8)
_PLAIN[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_PLAIN[0x80:] = np.arange(0x80, 0x100)


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts in lower case: ASCII other than letters is one space a run, and none stands at the start of a text."""
    raw, at = utf8(pc.utf8_lower(texts.fill_null("") if texts.null_count else texts))
    plain = _PLAIN[raw]
    space = plain == _SPACE
    double = space.copy()
    double[1:] &= space[:-1]
    starts = at[:-1][at[:-1] < at[1:]]
    double[starts] = space[starts]
    keep = ~double
    return plain[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def suffix_automaton(text: bytes | np.ndarray) -> list[dict[int, int]]:
    """The transitions of the least automaton of all substrings; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in text:
        c = int(c)
        new = len(moves)
        moves.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


@dataclass
class LanguageModel:
    """Sample text by language: bounded, and all that travels to the workers."""

    names: list[str]
    samples: list[list[bytes]]

    @functools.cached_property
    def key(self) -> int:
        return zlib.crc32(repr((self.names, self.samples)).encode())

    def parser(self) -> Parser:
        """The automata, built once in each worker."""
        if Parser.latest is None or Parser.latest[0] != (self.key, len(self.names)):
            Parser.latest = ((self.key, len(self.names)), Parser(self.samples))
        return Parser.latest[1]


class Parser:
    """Dense automata of all languages under one numbering of bytes. A cell holds the next state's row, with the top bit set
    where the match ends before the byte and a phrase starts with it."""

    latest: tuple | None = None

    def __init__(self, samples: list[list[bytes]]):
        used = sorted(set(b"".join(b"".join(s) for s in samples)))
        self.classes = np.zeros(256, np.int32)  # 0: bytes of no sample, and the seam between two texts of a sample
        self.classes[used] = np.arange(1, len(used) + 1)
        wide = len(used) + 1
        tables, self.roots, self.bits, base = [], [], [], 0
        for texts in samples:
            moves = suffix_automaton(np.concatenate([np.append(self.classes[np.frombuffer(t, np.uint8)], 0) for t in texts]) if texts else b"")
            table = np.full((len(moves), wide), -1, np.int64)
            for state, own in enumerate(moves):
                table[state, list(own)] = list(own.values())
            table[:, 0] = -1
            first = (np.where(table[0] >= 0, base + table[0] * wide, base) - (1 << 31)).astype(np.int64)
            table = np.where(table >= 0, base + table * wide, first[None, :])
            table[0] = first
            tables.append(table.astype(np.int32).ravel())
            self.roots.append(base)
            self.bits.append(math.log2(max(2, sum(map(len, texts)))))
            base += len(moves) * wide
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)

    def phrases(self, plain: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(texts, languages): how many phrases each text takes."""
        n, most = len(at) - 1, len(self.roots)
        count = -(-np.diff(at) // STRETCH)
        of = np.repeat(np.arange(n), count)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        begin = at[:-1][of] + nth * STRETCH
        size = np.minimum(at[1:][of] - begin, STRETCH)
        order = np.argsort(-size, kind="stable")
        told = self.classes[plain]
        out = np.zeros((n, most), np.int64)
        for part in np.array_split(order, max(1, -(-len(order) // 8192))):
            if not len(part):
                continue
            start, long = begin[part], size[part]
            row = np.repeat(np.array(self.roots, np.int32)[:, None], len(part), axis=1)
            found = np.zeros((most, len(part)), np.int32)
            live = len(part)
            for t in range(int(long[0])):
                while long[live - 1] <= t:
                    live -= int(np.searchsorted(long[:live][::-1], t, "right"))
                cell = self.table[row[:, :live] + told[start[:live] + t]]
                found[:, :live] -= cell >> 31
                row[:, :live] = cell & 0x7FFFFFFF
            np.add.at(out, of[part], found.T)
        return out


def fit_language(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = 64, each: int = 1024, cells: int = 1 << 23) -> LanguageModel:
    """Learns from a bounded sample: of each value of ``lang_col`` at most ``rows`` different texts in order of their hash, a stretch of at most ``each``
    bytes of each, at a place that the hash chooses. Automata together get at most ``cells`` cells, so with many languages samples
    are shorter. Rows with a null language, a null text or one without letters teach nothing.
    """
    small_batches(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    known = known.withColumn("h", F.xxhash64("text"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    some = known.join(F.broadcast(sizes), "lang").where(  # a row for each language, as the model has
        (F.col("n") <= 8 * rows) | (F.pmod("h", F.col("n")) < 8 * rows)
    )  # about eight times what is taken
    some = some.groupBy("lang", "h").agg(F.min("text").alias("text"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    texts = some.withColumn("place", place).where(F.col("place") <= rows).select("lang", "h", "text")

    def cut(batches):
        for batch in batches:
            plain, at = letters(batch.column("text"))
            low = np.abs(batch.column("h").to_numpy()) % np.maximum(np.diff(at) - each, 1) + at[:-1]
            told = [plain[a : min(a + each, b)].tobytes() for a, b in zip(low, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(told, pa.binary())], names=["lang", "h", "told"])

    samples: dict[str, list[bytes]] = {}
    for r in sorted(texts.mapInArrow(cut, "lang string, h long, told binary").collect(), key=lambda r: (r["lang"], r["h"])):
        samples.setdefault(r["lang"], []).append(bytes(r["told"]))
    wide = len(set(b"".join(b"".join(s) for s in samples.values()))) + 1
    most = cells // (2 * wide * max(1, len(samples)))
    names = sorted(samples)
    for name in names:
        kept, room = [], most
        for told in samples[name]:
            kept.append(told[: max(0, room)])
            room -= len(told) + 1
        samples[name] = [t for t in kept if t]
    return LanguageModel(names, [samples[name] for name in names])


def _score(model: LanguageModel, own: tuple[str, str], lang_col: str, score_col: str):
    def run(batches):
        parser = model.parser()
        bits = np.array(parser.bits)
        for batch in batches:
            names = [c for c in batch.schema.names if c not in own]
            for first, part in pieces(batch.column(own[0]), 8 << 20):
                cost = parser.phrases(*letters(part)) * bits
                rows = batch.slice(first, len(part))
                known = np.asarray(rows.column(own[1]).to_numpy(zero_copy_only=False), bool) & bool(model.names)
                best = cost.argmin(axis=1) if model.names else np.zeros(len(part), np.int64)
                odds = np.exp2(-np.minimum(cost - cost.min(axis=1, keepdims=True), 1000)).sum(axis=1) if model.names else np.ones(len(part))
                told = pa.array([model.names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())], pa.string())
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), told, pa.array(np.where(known, 1 / odds, 0.0))], names=[*names, lang_col, score_col])

    return run


def identify_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All rows and columns with ``lang_col`` and ``score_col``; input columns of these names are replaced.

    The score is the share of the language found in the sum of 2^-bits over all languages. Defined cases: a null text or one without a letter is ``und`` with
    score 0, and so is any text if no language was learned; ties go to the name that sorts first; repeated rows get the same answer; whole texts of any length
    are parsed; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    rows = docs.drop(lang_col, score_col)
    own = (unused(docs.columns, "_text"), unused(docs.columns, "_letter"))
    shape = rows.schema.add(lang_col, "string").add(score_col, "double")
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = rows.withColumns({own[0]: F.col(text_col), own[1]: letter})
    return rows.mapInArrow(_score(model, own, lang_col, score_col), shape)
