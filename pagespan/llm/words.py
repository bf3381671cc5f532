"""Vectorised word splitting and hashing over Arrow string columns.

A word is a maximal run of bytes other than ASCII space, tab, LF, VT, FF and CR.
All functions work on the UTF-8 bytes of a column at once; nothing here is per row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_WS = np.zeros(256, bool)
_WS[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_SEG = 1 << 20


def inverse(a: int) -> int:
    """Inverse of an odd number modulo 2**64."""
    return pow(int(a), -1, 1 << 64)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown by doubling."""
    p = _powers.get(base)
    if p is None or len(p) < n:
        size = max(n, 1024, 2 * (0 if p is None else len(p)))
        p = np.full(size, base, np.uint64)
        p[0] = 1
        p = np.multiply.accumulate(p)
        _powers[base] = p
    return p[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


@dataclass
class Words:
    """Words of some texts: byte spans in buf, and the first word of each text (n + 1 entries)."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.start, self.end)

    def text_of(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def raw(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z."""
    return _LOWER[buf]


def split(buf: np.ndarray, off: np.ndarray) -> Words:
    """Words of the texts that lie in buf between the offsets."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(buf, z, z, np.zeros(len(off), np.int64))
    solid = ~_WS[buf]
    edge = np.empty(n, bool)
    edge[0] = True
    np.logical_not(solid[:-1], out=edge[1:])
    at = off[:-1]
    edge[at[at < n]] = True
    start = np.flatnonzero(solid & edge)
    edge[-1] = True
    np.logical_not(solid[1:], out=edge[:-1])
    last = off[1:] - 1
    edge[last[last >= 0]] = True
    end = np.flatnonzero(solid & edge) + 1
    return Words(buf, start, end, np.searchsorted(start, off))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = int(_BASE)) -> np.ndarray:
    """64-bit hash of each byte span (spans ascend and don't overlap), in segments of bounded size."""
    out = np.empty(len(start), np.uint64)
    i, inv = 0, inverse(base)
    while i < len(start):
        lo = start[i]
        j = max(i + 1, int(np.searchsorted(end, lo + _SEG, "right")))
        hi = int(end[j - 1])
        size = hi - int(lo)
        cum = np.empty(size + 1, np.uint64)
        cum[0] = 0
        np.cumsum((buf[lo:hi].astype(np.uint64) + U(1)) * powers(base, size), out=cum[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix((cum[e] - cum[s]) * powers(inv, size + 1)[s] + (e - s).astype(np.uint64) * U(0xD6E8FEB86659FD93))
        i = j
    return out


def rolling(h: np.ndarray, n: int, mul: int = 0xA0761D6478BD642F) -> np.ndarray:
    """Hash of each n consecutive values (len(h) - n + 1 of them, or none); windows may cross texts."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m].copy()
    for j in range(1, n):
        out *= U(mul)
        out += h[j : j + m]
    return mix(out)


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """Starts of the windows of n words that lie within one text."""
    total = int(first[-1])
    m = total - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    ok = np.ones(m, bool)
    for back in range(1, n):
        # a window that starts `back` words before the next text's first word is not inside
        at = first[1:-1] - back
        ok[at[(at >= 0) & (at < m)]] = False
    # texts shorter than n: starts before the text's own first word were handled above by earlier boundaries
    return np.flatnonzero(ok)


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    m, have = h, 1
    while 2 * have <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = w - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def slices(col, limit: int = 4 << 20):
    """Ranges of rows whose texts have about `limit` bytes together; a longer text stands alone."""
    _, off = raw(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
