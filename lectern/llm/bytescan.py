"""Vectorised scanning of UTF-8 text columns held in Arrow buffers.

The Python-side operators of this subpackage work on the raw bytes of an Arrow string column: word
boundaries, 64-bit word hashes and per-document counts come from whole-buffer numpy operations, so
no Python loop runs per word.  Buffers are cut into slices of about ``SLICE`` bytes (never inside a
document), which bounds the memory of a worker whatever the size of the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Bytes that do not start a code point.
CONT = np.zeros(256, dtype=bool)
CONT[0x80:0xC0] = True
NOT_SPACE = ~SPACE
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after ASCII lower-casing: digits, a-z and all non-ASCII bytes.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two xor-shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD1342543DE82EF95)
_INV = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _pow(base: np.uint64, n: int) -> np.ndarray:
    key = str(int(base))
    if key not in _powers or len(_powers[key]) < n:
        full = np.full(max(n, SLICE), base, dtype=np.uint64)
        full[0] = 1
        _powers[key] = np.multiply.accumulate(full)
    return _powers[key][:n]


@dataclass
class Slice:
    """Documents ``first`` to ``first + n`` of a batch: bytes, and where each document begins."""

    first: int
    data: np.ndarray
    off: np.ndarray

    @property
    def n(self) -> int:
        return len(self.off) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE) -> Iterator[Slice]:
    """Cut a string column into slices of whole documents; a null is an empty document."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    bufs = texts.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield Slice(i, data[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


def words(s: Slice, kind: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and document index of each word of a slice, and the bytes they refer to."""
    data = LOWER[s.data] if lower else s.data
    m = kind[data]
    if not len(m):
        z = np.zeros(0, np.int64)
        return z, z, z, data
    edge = s.off[(s.off > 0) & (s.off < len(m))]
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    first[edge] = m[edge]
    last[edge - 1] = m[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(s.off, starts, side="right") - 1, data


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from one prefix sum of a polynomial modulo 2**64."""
    n = len(data)
    h = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _pow(_BASE, n), out=h[1:])
    return mix((h[ends] - h[starts]) * _pow(_INV, n + 1)[starts] + (ends - starts).astype(np.uint64))


_STEP = mix(np.arange(11, 75, dtype=np.uint64)) | np.uint64(1)


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes."""
    n = max(0, len(h) - width + 1)
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out += h[k : k + n] * _STEP[k]
    return mix(out)


def per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of set flags between consecutive offsets."""
    c = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=c[1:])
    return np.diff(c[off])
