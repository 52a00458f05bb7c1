"""Vectorised views of a column of texts: words, lines and their hashes straight from the Arrow buffer.

A *block* is a run of whole documents of about ``BLOCK_BYTES`` bytes (one document may exceed it). Words are
maximal runs of bytes outside ``\\x20\\x09-\\x0D``; those bytes never occur inside a UTF-8 sequence, so the byte
view and the code point view have the same words. Every hash is 64 bits and depends on the content alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240101)).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_STEP = 4096


def _low(base: int) -> np.ndarray:
    return np.array([pow(base, i, 1 << 64) for i in range(_STEP)], _U)


#: Powers of the base and of its inverse: those below _STEP, and those of multiples of _STEP as far as needed so far.
_lows = [_low(_BASE), _low(_INV)]
_highs = [np.ones(1, _U), np.ones(1, _U)]


def _pow(at: np.ndarray, which: int, n: int) -> np.ndarray:
    """base ** at (which 0) or inverse ** at (1), modulo 2 ** 64, for places below n."""
    while len(_highs[which]) * _STEP < n:
        have = _highs[which]
        step = pow((_BASE, _INV)[which], _STEP * len(have), 1 << 64)
        _highs[which] = np.concatenate([have, have * _U(step)])
    return _lows[which][at & (_STEP - 1)] * _highs[which][at // _STEP]


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
NOT_CONTINUATION = np.ones(256, bool)
NOT_CONTINUATION[0x80:0xC0] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit moves every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Block:
    """Whole documents laid end to end. ``buf``: bytes; ``offs``: where each document starts, and the end."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.offs, self.n = buf, offs, len(offs) - 1
        self._prefix: np.ndarray | None = None

    @property
    def starts(self) -> np.ndarray:
        at = self.offs[:-1]
        return at[at < len(self.buf)]

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many of the bytes flagged lie in each document."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offs[1:]] - total[self.offs[:-1]]

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offs[1:], at, side="right")

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of True that stay inside one document."""
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cut = self.starts
        first[cut] |= inside[cut]
        cut = cut[cut > 0] - 1
        last[cut] |= inside[cut]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Content hash of each byte range."""
        n = len(self.buf)
        if self._prefix is None:
            self._prefix = np.zeros(n + 1, _U)
            for at in range(0, n, BLOCK_BYTES):
                part = _TABLE[self.buf[at : at + BLOCK_BYTES]] * _pow(np.arange(at, min(n, at + BLOCK_BYTES)), 0, n + 1)
                np.cumsum(part, out=self._prefix[at + 1 : at + 1 + len(part)])
                self._prefix[at + 1 : at + 1 + len(part)] += self._prefix[at]
        h = (self._prefix[end] - self._prefix[start]) * _pow(start, 1, n + 1)
        return mix(h + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of every word."""
        start, end = self.runs(~WHITE[self.buf])
        return start, end, self.doc_of(start)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of every \\n-split line that holds a word."""
        start, end = self.runs(self.buf != 0x0A)
        if len(start):
            total = np.concatenate([[0], np.cumsum(~WHITE[self.buf], dtype=np.int64)])
            has = total[end] > total[start]
            start, end = start[has], end[has]
        return start, end, self.doc_of(start)

    def text(self, k: int) -> str:
        return self.buf[self.offs[k] : self.offs[k + 1]].tobytes().decode("utf-8", "replace")


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several hash columns, order mattering."""
    out = np.zeros(len(parts[0]), _U)
    for p in parts:
        out = mix(out * _U(0x2545F4914F6CDD1D) + p)
    return out


def windows(h: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words inside one document, and the index of its first word."""
    if len(h) < width:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[: len(doc) - width + 1] == doc[width - 1 :])
    return combine([h[at + k] for k in range(width)]), at


def later_copies(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags: the key occurred before in its document; the key occurs twice or more in it."""
    if not len(key):
        return np.zeros(0, bool), np.zeros(0, bool)
    key = combine([key, doc.astype(_U)])
    _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    before = np.ones(len(key), bool)
    before[first] = False
    return before, (count > 1)[inverse]


def blocks(column: pa.Array | pa.ChunkedArray, limit: int | None = None):
    """(first row, Block) for runs of rows of a string or binary column; null counts as empty."""
    limit = limit or BLOCK_BYTES
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, Block(raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
        at = to
