"""Texts cut into segments whose tokens don't depend on their surroundings, and what is known of each distinct one.

A segment is a run of spaces and what follows up to the next space after a visible character.  No token of a byte-level
vocabulary with the usual word pattern, or of a piece vocabulary without pieces that go on after an inner space, crosses
such a border; so a text's tokens are its segments' tokens, one after the other, and each distinct segment is encoded once.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa

BYTE = 0x20
ADDED = 20_000  # segments encoded together


def split(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """(distinct segments, index, cuts): text i has the segments index[cuts[i] : cuts[i + 1]]; no text may be null.

    Only a space after an ASCII sign, a two-byte letter or a common three-byte one begins a segment; after all others,
    among which are the wide spaces, the segment goes on.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    if low == high:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)
    at = np.flatnonzero(raw[low + 1 : high] == BYTE) + low + 1
    a, b, c = raw[at - 1], raw[np.maximum(at - 2, 0)], raw[np.maximum(at - 3, 0)]
    inner = (b >= 0x80) & (b < 0xC0)
    seen = ((a > BYTE) & (a < 0x7F)) | ((a >= 0x80) & (((b >= 0xC3) & (b <= 0xDF)) | (inner & (((c >= 0xE4) & (c <= 0xEC)) | ((c == 0xE3) & (b > 0x80))))))
    mark = np.zeros(high - low + 1, bool)
    mark[at[seen] - low] = True
    mark[offsets - low] = True
    mark[-1] = False
    starts = np.flatnonzero(mark) + low
    ends = np.append(starts, high).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), texts.buffers()[2]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(starts, offsets)


def gather(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """values[start[i] : start[i] + length[i]] of every i, one after the other."""
    ends = np.cumsum(length)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.arange(ends[-1]) + np.repeat(start - ends + length, length)]


def sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The sum of values[cuts[i] : cuts[i + 1]] of every i."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[cuts])


class Memo:
    """The slots of distinct segments in a worker's tables, from batch to batch.

    ``add(segments)`` appends to the tables; a Memo that holds more than ``most`` segments or ``chars`` signs is emptied
    before the next batch.
    """

    def __init__(self, tables: Callable[[], object], most: int = 250_000, chars: int = 8_000_000) -> None:
        self.make, self.most, self.chars = tables, most, chars
        self.tables, self.known, self.held = tables(), {}, 0

    def clear(self) -> None:
        self.tables, self.known, self.held = self.make(), {}, 0

    def slots(self, distinct: pa.StringArray) -> np.ndarray:
        if len(self.known) > self.most or self.held > self.chars:
            self.clear()
        words, known = distinct.to_pylist(), self.known
        new = [w for w in words if w not in known]
        if new:
            first = len(known)
            self.held += sum(map(len, new))
            for k in range(0, len(new), ADDED):
                self.tables.add(new[k : k + ADDED])
            known.update(zip(new, range(first, first + len(new)), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


class Ragged:
    """Arrays of one kind, one after the other, that can be added to."""

    def __init__(self, kind: type) -> None:
        self.values, self.ends, self.size, self.n = np.zeros(1 << 12, kind), np.zeros(1 << 10, np.int64), 0, 0

    @staticmethod
    def _room(x: np.ndarray, n: int) -> np.ndarray:
        return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        self.values = self._room(self.values, self.size + len(values))
        self.ends = self._room(self.ends, self.n + len(lengths))
        self.values[self.size : self.size + len(values)] = values
        self.ends[self.n : self.n + len(lengths)] = self.size + np.cumsum(lengths)
        self.size, self.n = self.size + len(values), self.n + len(lengths)

    def lengths(self) -> np.ndarray:
        return np.diff(self.ends[: self.n], prepend=0)

    def of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of the slots, one after the other; each slot's number of values)."""
        length = self.lengths()[slots]
        return gather(self.values, self.ends[slots] - length, length), length


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(lengths.sum())), lengths
