"""Array routines on packed UTF-8 bytes, used inside Spark tasks.

Strings are ranges of one byte buffer.  Prefix sums of ``table[byte] * B**i``
(mod 2**64, ``B`` odd, so powers can be undone) give the hash of any range by
one subtraction and one product; equal hashes are confirmed on the bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

from .common import ships

_RNG = np.random.default_rng(20240229)
BYTE_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        up = np.full(size, BASE, dtype=np.uint64)
        up[0] = 1
        inv = np.uint64(pow(int(BASE), -1, 2**64))
        down = np.full(size, inv, dtype=np.uint64)
        down[0] = 1
        _powers["up"], _powers["down"] = np.cumprod(up), np.cumprod(down)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise a 64-bit hash (two multiply / shift rounds)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def prefix(data: np.ndarray) -> np.ndarray:
    up, _ = _power_tables(len(data) + 1)
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(BYTE_TABLE[data] * up[:len(data)], out=out[1:])
    return out


def range_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _power_tables(len(pre))
    h = (pre[end] - pre[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64))


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of ``w`` values (``len(v) - w + 1`` results)."""
    n = len(v) - w + 1
    if n <= 0:
        return v[:0]
    m, cur = v, 1
    while cur * 2 <= w:
        m = np.minimum(m[:len(m) - cur], m[cur:])
        cur *= 2
    if cur < w:
        m = np.minimum(m[:n], m[w - cur:w - cur + n])
    return m[:n]


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of the given ranges, one after the other."""
    total = int(length.sum())
    if total == 0:
        return np.empty(0, dtype=data.dtype)
    ends = np.cumsum(length)
    shift = np.repeat(start - (ends - length), length)
    return data[shift + np.arange(total)]


def unaligned_words(data: np.ndarray) -> np.ndarray:
    """View of the 8 bytes at every position as little-endian integers."""
    return np.ndarray(shape=(max(0, len(data) - 7),), dtype="<u8", buffer=data, strides=(1,))


def padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(8, dtype=np.uint8)])


def first_difference(words: np.ndarray, a: np.ndarray, b: np.ndarray,
                     limit: np.ndarray, start: int = 0) -> np.ndarray:
    """Length of the common prefix of the strings at ``a`` and ``b``, at most
    ``limit``; the first ``start`` bytes are known to agree."""
    n = len(a)
    lcp = np.full(n, start, dtype=np.int64)
    np.minimum(lcp, limit, out=lcp)
    live = np.flatnonzero(lcp < limit)
    at = start
    while len(live):
        x = words[a[live] + at] ^ words[b[live] + at]
        differ = x != 0
        if differ.any():
            d = x[differ]
            low = d & (~d + np.uint64(1))
            step = (np.log2(low.astype(np.float64)).astype(np.int64)) >> 3
            hit = live[differ]
            lcp[hit] = np.minimum(at + step, limit[hit])
            live = live[~differ]
        at += 8
        lcp[live] = np.minimum(at, limit[live])
        live = live[at < limit[live]]
    return lcp


class HashSet:
    """Membership of 64-bit hashes in a small fixed set."""

    def __init__(self, values):
        self.values = np.unique(np.asarray(values, dtype=np.uint64))
        self.slots = np.zeros(1 << 16, dtype=bool)
        self.slots[(self.values >> np.uint64(48)).astype(np.int64)] = True

    def contains(self, h: np.ndarray) -> np.ndarray:
        if len(self.values) == 0:
            return np.zeros(len(h), dtype=bool)
        out = self.slots[(h >> np.uint64(48)).astype(np.int64)]
        at = np.flatnonzero(out)
        found = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
        out[at] = self.values[found] == h[at]
        return out


def selection_key(h: np.ndarray, frequent: HashSet, low: np.uint64) -> np.ndarray:
    """Order in which hashed grams are chosen as anchors: by hash, later
    positions first among equals, and frequent grams after all others.  The
    position is in the low bits (``low`` less the index)."""
    key = ((h >> np.uint64(1)) & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    key[frequent.contains(h)] |= np.uint64(1 << 63)
    return key


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string column without a copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64 if wide else np.int32)
    off = off[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and bufs[2].size \
        else np.empty(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


LEVEL = 3


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of known types as one compressed payload (lengths in front)."""
    head = np.array([a.nbytes for a in arrays], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=LEVEL).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(payload: bytes, dtypes: list) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    sizes = np.frombuffer(raw, dtype=np.int64, count=len(dtypes))
    out, at = [], 8 * len(dtypes)
    for size, kind in zip(sizes.tolist(), dtypes):
        out.append(np.frombuffer(raw, dtype=kind, count=size // np.dtype(kind).itemsize, offset=at))
        at += size
    return out


def runs(flags: np.ndarray, owner: np.ndarray, position: np.ndarray):
    """Maximal runs of flagged elements that follow each other (position + 1)
    under one owner: indices of the first and last element of each run."""
    idx = np.flatnonzero(flags)
    if len(idx) == 0:
        return idx, idx
    new = np.ones(len(idx), dtype=bool)
    new[1:] = (owner[idx[1:]] != owner[idx[:-1]]) | (position[idx[1:]] != position[idx[:-1]] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(idx)) - 1
    return idx[first], idx[last]


ships(__name__)
