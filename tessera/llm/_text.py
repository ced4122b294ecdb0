"""Vectorised word segmentation and hashing over the UTF-8 bytes of Arrow string columns.

Words are ``[^\\x20\\x09-\\x0D]+``. The separators are ASCII, so words can be cut on bytes: no byte of
a multi-byte UTF-8 character equals one of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once by one numpy pass; a longer document is a pass of its own, whole.
CHUNK_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_PLACE = np.uint64(0x9E6C63D0676A9A99)
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on a uint64 array."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(column: pa.Array, most: int = CHUNK_BYTES):
    """(first row, slice) of runs of rows with at most ``most`` bytes together, or of one longer row."""
    _, at = utf8(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, column.slice(i, j - i)
        i = j


class Words:
    """The words of a string column: byte spans ``start``/``end``, and ``of``, the words of row i being ``of[i]:of[i+1]``."""

    def __init__(self, column: pa.Array, lower: bool = False):
        raw, self.offsets = utf8(column)
        self.bytes = _LOWER[raw] if lower else raw
        n = len(raw)
        word = ~_SEPARATOR[raw]
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        before, after = cut[:n].copy(), cut[1:].copy()
        before[1:] |= ~word[:-1]
        after[:-1] |= ~word[1:]
        self.start = np.flatnonzero(word & before)
        self.end = np.flatnonzero(word & after) + 1
        self.of = np.searchsorted(self.start, self.offsets)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; hashes of different seeds are independent. Each eight bytes are mixed with their place, then added up."""
        if not len(self):
            return np.zeros(0, np.uint64)
        eights = np.ndarray(len(self.bytes), "<u8", np.concatenate([self.bytes, np.zeros(8, np.uint8)]), strides=(1,))
        salt = mix64(np.array([seed], np.uint64))
        size = self.end - self.start
        count = (size + 7) >> 3
        if count.max() == 1:
            total = mix64((eights[self.start] & _TAIL[size]) + salt)
        else:
            first = np.cumsum(count) - count
            nth = np.arange(int(first[-1] + count[-1])) - np.repeat(first, count)
            at = np.repeat(self.start, count) + 8 * nth
            left = np.minimum(np.repeat(self.end, count) - at, 8)
            total = np.add.reduceat(mix64(((eights[at] & _TAIL[left]) + salt) ^ (nth.astype(np.uint64) * _PLACE)), first)
        return mix64(total ^ (size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))

    def text(self, i: int) -> bytes:
        return self.bytes[self.start[i] : self.end[i]].tobytes()


def grams(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of the n-grams starting at each position; those that run past the end are left out."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(size, np.uint64(seed), np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD1342543DE82EF95) + hashes[k : k + size]
    return mix64(out)


def within(of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(valid, of2): which n-grams of the concatenated rows lie in one row; offsets of the rows in the valid ones."""
    total = int(of[-1])
    size = max(0, total - n + 1)
    counts = np.maximum(np.diff(of) - n + 1, 0)
    valid = np.zeros(total + 1, np.int32)
    full = counts > 0
    np.add.at(valid, of[:-1][full], 1)
    np.add.at(valid, (of[:-1] + counts)[full], -1)
    return np.cumsum(valid)[:size] > 0, np.concatenate([[0], np.cumsum(counts)])
