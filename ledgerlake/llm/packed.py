"""Columns of numbers packed into one binary value, for exchanges of many small entries."""

from __future__ import annotations

import struct

import numpy as np
import xxhash
import zstandard

_ZIP = zstandard.ZstdCompressor(level=1)
_UNZIP = zstandard.ZstdDecompressor()
_HEAD = struct.Struct("<B2sQ")


def pack(*columns: np.ndarray) -> bytes:
    """One-dimensional arrays; bytes of equal weight lie together, which compresses sorted numbers well."""
    parts = [struct.pack("<B", len(columns))]
    for c in columns:
        c = np.ascontiguousarray(c)
        parts.append(_HEAD.pack(c.dtype.itemsize, c.dtype.str[1:].encode()[:2], len(c)))
        planes = c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T if len(c) else np.empty((0,), np.uint8)
        parts.append(np.ascontiguousarray(planes).tobytes())
    return _ZIP.compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = _UNZIP.decompress(blob)
    at, out = 1, []
    for _ in range(raw[0]):
        size, kind, n = _HEAD.unpack_from(raw, at)
        at += _HEAD.size
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view("<" + kind.decode()))
        at += n * size
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: Longer parts are hashed one by one.
_LONG = 512


def keyed(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of 64 bits of the bytes [start, end) of each part, independent of each other.

    Eight bytes at a time are mixed into two states that begin with the part's length and ``key``. With a key drawn
    for each run, no two texts that meet in a hash can be written down beforehand.
    """
    size = (end - start).astype(np.int64)
    k0, k1 = (np.uint64((key * m + 0x9E3779B97F4A7C15 * m) % (1 << 64)) for m in (1, 0xD1342543DE82EF95))
    h, g = mixed(size.astype(np.uint64) + k0), mixed(size.astype(np.uint64) ^ k1)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    keep = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    live = np.flatnonzero((size > 0) & (size <= _LONG))
    at, left = start[live], size[live]
    while len(live):
        part = words[at] & keep[np.minimum(left, 8)]
        h[live] = mixed(h[live] + part)
        turned = (g[live] ^ part) * np.uint64(0xA0761D6478BD642F)
        g[live] = turned ^ (turned >> np.uint64(29))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > _LONG).tolist():
        both = xxhash.xxh3_128_intdigest(data[start[k] : end[k]].tobytes(), key & ((1 << 64) - 1))
        h[k], g[k] = both >> 64, both & ((1 << 64) - 1)
    return h, mixed(g)


def dealt(x: np.ndarray, n: int) -> np.ndarray:
    """A bucket below ``n`` for each scrambled number, by its high bits."""
    return ((x >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def by_bucket(bucket: np.ndarray, *columns: np.ndarray):
    """(bucket, columns of its rows), in the given order inside each bucket."""
    # Numbers of 16 bits are sorted by digits, in the same order.
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and 0 <= bucket.min() and bucket.max() < 1 << 16 else bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, int)
    for at, end in zip(cuts, np.r_[cuts[1:], len(bucket)]):
        pick = order[at:end]
        yield int(bucket[at]), [c[pick] for c in columns]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers start, start + 1, ... of each range, and which range each is of."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    return np.arange(len(owner)) - first[owner] + starts[owner], owner
