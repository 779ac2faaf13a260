"""Byte grams: rolling keys over whole texts, exact counts, and a bounded table of what a model says of a gram.

A gram of order d is a byte with the d bytes before it, packed into an integer, the newest byte lowest. Before
the first byte of a text the context is zero bytes, so contexts never cross texts.
"""

from __future__ import annotations

import numpy as np

from tessera.llm._common import find, merge_counts

#: Distinct grams that a task holds before it hands them on.
FLUSH = 1_500_000


def gram_keys(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of every byte of the texts, in turn, and the lengths of the texts."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    keys = data.astype(np.uint64)
    for j in range(1, order + 1):
        keys[j:] |= data[:-j].astype(np.uint64) << np.uint64(8 * j)
    starts = np.cumsum(lens) - lens
    for j in range(order):
        at = starts[lens > j] + j
        keys[at] &= np.uint64((1 << (8 * (j + 1))) - 1)
    return keys, lens


class GramCounter:
    """Counts of (tag, gram) in bounded memory; drained from time to time."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.parts.append((k, n))
        self.held += len(k)
        if self.held > 2 * FLUSH and len(self.parts) > 1:
            self.parts = [merge_counts(self.parts)]
            self.held = len(self.parts[0][0])

    def full(self) -> bool:
        return self.held > FLUSH and len(self.parts) == 1

    def drain(self) -> tuple[np.ndarray, np.ndarray]:
        out = merge_counts(self.parts)
        self.parts, self.held = [], 0
        return out


class Codes:
    """Values of the hot grams (sorted keys, a row of values each), behind a table of fixed size of those met last. A gram that
    is not hot has NaN."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int = 18) -> None:
        self.hot, self.all, self.shift = keys, values, np.uint64(64 - bits)
        self.keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.full((1 << bits, values.shape[1]), np.nan)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slots(keys)
        out = self.values[slot]
        miss = np.flatnonzero(self.keys[slot] != keys)
        if len(miss):
            wanted, back = np.unique(keys[miss], return_inverse=True)
            at = find(self.hot, wanted)
            got = np.full((len(wanted), self.all.shape[1]), np.nan)
            got[at >= 0] = self.all[at[at >= 0]]
            out[miss] = got[back]
            at = self.slots(wanted)
            self.keys[at], self.values[at] = wanted, got
        return out


def cold_by_text(keys: np.ndarray, values: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets by text, keys, times) of the grams without a value; those get the value zero in `values`."""
    at = np.flatnonzero(np.isnan(values[:, 0]))
    values[at] = 0.0
    text = np.searchsorted(np.cumsum(lens), at, "right")
    order = np.lexsort((keys[at], text))
    text, k = text[order], keys[at][order]
    first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (k[1:] != k[:-1])]) if len(k) else np.empty(0, np.int64)
    times = np.diff(np.r_[first, len(k)])
    return np.searchsorted(text[first], np.arange(len(lens) + 1)), k[first], times


def sums_by_text(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Column sums of values for each text; zero for an empty one."""
    out = np.zeros((len(lens), values.shape[1]))
    some = np.flatnonzero(lens)
    if len(some):
        starts = (np.cumsum(lens) - lens)[some]
        out[some] = np.add.reduceat(values.astype(np.float64), starts, axis=0)
    return out
