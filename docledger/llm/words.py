"""Word hashes of whole texts, worked out on the UTF-8 bytes of an Arrow column.

A word is a maximal run of bytes outside a separator set, so it never crosses a document. Its hash is a polynomial over its
bytes, read off one running sum, then mixed; phrases hash the hashes of their words. The buffer is worked in pieces that end
at a separator, so memory follows the piece and not the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
#: Everything below 128 that is no letter and no digit.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD1342543DE82EF95)


@dataclass
class Words:
    """start, end: byte places of each word in data; first: number of the first word of each text, and one more for the end."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text starts; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (_BASE, _BACK)]
    return _powers[0], _powers[1]


def _pieces(sep: np.ndarray, edges: np.ndarray) -> list[tuple[int, int]]:
    """Cuts of the buffer at most PIECE long, just after a separator or where a text starts; longer only within one word."""
    out, a, n = [], 0, len(sep)
    while a < n:
        b = min(a + PIECE, n)
        if b < n:
            edge = int(edges[np.searchsorted(edges, b, side="right") - 1])
            cut = np.flatnonzero(sep[a:b][::-1][: 1 << 16])
            near = b - int(cut[0]) if len(cut) else a
            b = max(edge, near)
            while b <= a:  # one word fills the piece
                more = np.flatnonzero(sep[a + PIECE :][: 1 << 24])
                end = a + PIECE + int(more[0]) + 1 if len(more) else n
                b = min(end, int(edges[np.searchsorted(edges, a, side="right")]))
        out.append((a, b))
        a = b
    return out


def _split_tails(data: np.ndarray, s: np.ndarray, e: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut the run of tail bytes off each word whose last byte before it is an ASCII letter."""
    cut = e.copy()
    open_ = np.flatnonzero(tail[data[e - 1]])
    while len(open_):
        cut[open_] -= 1
        open_ = open_[cut[open_] > s[open_]]
        open_ = open_[tail[data[cut[open_] - 1]]]
    letter = (SAME[data[np.maximum(cut, 1) - 1]] | 32) - 97 < 26
    own = (cut > s) & (cut < e) & letter
    if not own.any():
        return s, e
    n = own.astype(np.int64) + 1
    at = np.cumsum(n) - 1
    ss, ee = np.repeat(s, n), np.repeat(e, n)
    ss[at[own]] = cut[own]
    ee[at[own] - 1] = cut[own]
    return ss, ee


def words(column: pa.Array, separators: np.ndarray = WHITE, fold: np.ndarray = SAME, tail: np.ndarray | None = None) -> Words:
    """fold maps bytes before hashing, such as LOWER for A-Z. tail: bytes that become a word of their own after a letter."""
    data, at = utf8(column)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, none.astype(np.uint64), np.zeros(len(at), np.int64))
    sep = separators[data]
    starts, ends, hashes = [], [], []
    edges = np.unique(at)
    for a, b in _pieces(sep, edges):
        inside = ~sep[a:b]
        before = np.empty(b - a, bool)
        before[0], before[1:] = True, sep[a : b - 1]
        own = edges[(edges >= a) & (edges < b)] - a
        before[own] = True
        after = np.empty(b - a, bool)
        after[-1], after[:-1] = True, sep[a + 1 : b]
        after[own[own > 0] - 1] = True
        s, e = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
        if tail is not None and len(s):
            s, e = _split_tails(data[a:b], s, e, tail)
        power, back = _power(b - a)
        total = np.empty(b - a + 1, np.uint64)
        total[0] = 0
        np.cumsum((fold[data[a:b]].astype(np.uint64) + np.uint64(1)) * power[: b - a], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * back[s] + (e - s).astype(np.uint64) * _STEP))
        starts.append(s + a)
        ends.append(e + a)
    start = np.concatenate(starts)
    return Words(data, start, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(start, at))


def phrases(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, by place of their first word, and which of them stay within one text."""
    n = len(w.hash)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h = w.hash[: n - k + 1].copy()
    for j in range(1, k):
        h *= _STEP
        h += w.hash[j : n - k + 1 + j]
    whole = np.ones(n - k + 1, bool)
    for back in range(1, k):
        cut = w.first[1:-1] - back
        whole[cut[(cut >= 0) & (cut < len(whole))]] = False
    return mix(h), whole


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for count[0] values, then the same for the others."""
    total = int(count.sum())
    shift = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else first, count)
    return np.arange(total) + shift


def slices(batch: pa.RecordBatch, text: int, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of about so many text bytes, one row at least."""
    length = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0))
    group = (np.cumsum(length) - length) // size
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)
