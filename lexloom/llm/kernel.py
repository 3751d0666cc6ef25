"""Vectorised text kernels over Arrow string buffers.

A batch of texts is one byte buffer with offsets; words, lines and windows are
found with numpy over that buffer, so there is no Python loop per word. Hashes
are 64-bit polynomial prefix hashes with a final mix. Batches are worked on in
pieces of about ``PIECE`` bytes (a longer text is one piece), which bounds the
temporary arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 19
U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD6E8FEB86659FD93 | 1


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table over byte values: True inside any of the closed ranges."""
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


#: Words ``[^\x20\x09-\x0D]+``.
SPACED = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of a text in lower case (A-Z folded by the caller's table).
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_P))
_BYTE_LOWER = _BYTE[LOWER]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i up to n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, PIECE // 4)
        up, down = np.full(size, base, U64), np.full(size, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        have = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        if size <= 4 * PIECE:
            _powers[base] = have
    return have


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base^i, with a leading 0."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(base, len(values))[0][: len(values)], out=out[1:])
    return out


def spans_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the ranges [start, end) from prefix sums; equal contents give equal hashes."""
    return mix((pre[end] - pre[start]) * powers(base, len(pre))[1][start] + (end - start).astype(U64) * U64(_Q))


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow string column; a null counts as an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, off, data = col.buffers()
    if not len(col):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(off, kind, len(col) + 1 + col.offset)[col.offset :].astype(np.int64)
    return off, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def pieces(col, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets from 0, bytes) for runs of texts of about ``size`` bytes."""
    off, data = buffers(col)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield lo, hi, off[lo : hi + 1] - off[lo], data[off[lo] : off[hi]]
        lo = hi


class Words:
    """Words of a piece: start and end bytes, and ``ptr``: the first word of each text."""

    def __init__(self, off: np.ndarray, data: np.ndarray, inside: np.ndarray = SPACED, lower: bool = False):
        self.off, self.data, self.lower = off, data, lower
        m = np.zeros(len(data) + 2, bool)
        np.take(inside, data, out=m[1:-1])
        cut = np.zeros(len(data) + 1, bool)
        cut[off] = True
        self.start = np.flatnonzero(m[1:] & (~m[:-1] | cut))
        self.end = np.flatnonzero(m[:-1] & (~m[1:] | cut))
        self.ptr = np.searchsorted(self.start, off)
        self.count = np.diff(self.ptr)

    @property
    def text(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word (A-Z folded if ``lower``)."""
        pre = prefix(np.take(_BYTE_LOWER if self.lower else _BYTE, self.data), _P)
        return spans_hash(pre, self.start, self.end, _P)

    def chars(self) -> np.ndarray:
        """Code points of each word."""
        c = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=c[1:])
        return c[self.end] - c[self.start]


def windows(hashes: np.ndarray, ptr: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of n words that lie inside a text: index of the first word, and hash."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    count = np.diff(ptr)
    ok = np.arange(len(hashes)) + n <= np.repeat(ptr[1:], count)
    at = np.flatnonzero(ok)
    pre = prefix(hashes, _Q)
    return at, spans_hash(pre, at, at + n, _Q)


def lines(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text, split at \\n: start, end, and the first line of each text (a text has one at least)."""
    nl = np.flatnonzero(data == 0x0A)
    n_before = np.searchsorted(nl, off)
    texts = len(off) - 1
    ptr = n_before + np.arange(texts + 1)
    start, end = np.empty(len(nl) + texts, np.int64), np.empty(len(nl) + texts, np.int64)
    text_of_nl = np.searchsorted(off, nl, "right") - 1
    start[ptr[:-1]] = off[:-1]
    start[np.arange(len(nl)) + text_of_nl + 1] = nl + 1
    end[ptr[1:] - 1] = off[1:]
    end[np.arange(len(nl)) + text_of_nl] = nl
    return start, end, ptr


def bytes_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    return spans_hash(prefix(np.take(_BYTE, data), _P), start, end, _P)


def salted(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Keys that are equal only inside one text."""
    return mix(keys ^ mix(text.astype(U64) + U64(_Q)))


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: is it there twice or more, and is it an occurrence after the first."""
    s = np.sort(keys)
    dup = np.unique(s[1:][s[1:] == s[:-1]])
    again, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(dup):
        at = np.flatnonzero(member(keys, dup))
        order = at[np.argsort(keys[at], kind="stable")]
        k = keys[order]
        again[at] = True
        later[order[1:][k[1:] == k[:-1]]] = True
    return again, later


def member(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Is each key in the sorted array; a bit table on the low bits goes first."""
    if not len(among) or not len(keys):
        return np.zeros(len(keys), bool)
    size = 1 << max(10, int(len(among) * 8 - 1).bit_length())
    table = np.zeros(size, bool)
    table[(among & U64(size - 1)).astype(np.int64)] = True
    out = table[(keys & U64(size - 1)).astype(np.int64)]
    at = np.flatnonzero(out)
    k = keys[at]
    out[at] = among[np.minimum(np.searchsorted(among, k), len(among) - 1)] == k
    return out


def covered(n: int, start: np.ndarray, width) -> np.ndarray:
    """Which of n places lie inside any range [start, start + width)."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, start + width, -1)
    return np.cumsum(d[:-1]) > 0


def total(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of values for each text."""
    c = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bi" else values.dtype)
    np.cumsum(values, out=c[1:])
    return c[ptr[1:]] - c[ptr[:-1]]
