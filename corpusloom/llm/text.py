"""Vectorised text primitives over Arrow string buffers.

A *block* is a run of documents as one ``uint8`` buffer plus ``int64`` offsets.
Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; as those bytes never
occur inside a multi-byte UTF-8 sequence, byte rules and code point rules agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK_BYTES = 1 << 22
#: Words above this many bytes are hashed one by one with BLAKE2b.
LONG_WORD = 256

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASK = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], U64)
_C1, _C2, _K = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53), U64(0x9E3779B97F4A7C15)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U64(33))
    x = x * _C1
    x ^= x >> U64(33)
    x *= _C2
    x ^= x >> U64(33)
    return x


def string_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    arr = batch.column(batch.schema.get_field_index(name))
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    if pa.types.is_string_view(arr.type):
        arr = arr.cast(pa.large_string())
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    _, offs, data = arr.buffers()
    if len(arr) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    offsets = np.frombuffer(offs, kind, len(arr) + 1, arr.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(data: np.ndarray, offs: np.ndarray, limit: int = BLOCK_BYTES):
    """(first row, last row + 1, bytes, offsets) of runs of about `limit` bytes; one document is never cut."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, to, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and each document's range of words."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    at = offs[:-1][offs[:-1] < len(data)]
    first[at] = solid[at]
    at = offs[1:][offs[1:] > 0] - 1
    last[at] = solid[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes at a time."""
    size = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    h = size.astype(U64) * _K + U64(seed)
    h = mix(h ^ (lanes[starts] & _MASK[np.minimum(size, 8)]))
    left, at = np.flatnonzero(size > 8), 8
    while len(left):
        if at >= LONG_WORD:
            for i in left:
                raw = data[starts[i] : ends[i]].tobytes()
                h[i] = U64(int.from_bytes(hashlib.blake2b(raw, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little"))
            break
        x = lanes[starts[left] + at] & _MASK[np.minimum(size[left] - at, 8)]
        h[left] = mix(h[left] ^ x)
        at += 8
        left = left[size[left] > at]
    return h


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i below n; base is odd."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        up, down = np.full(n, base, U64), np.full(n, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        have = _POWERS[base] = (np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64))
    return have[0][:n], have[1][:n]


class Rolling:
    """Polynomial hashes of any run of a word-hash sequence from one prefix sum."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        up, self.down = powers(base, n + 1)
        self.sum = np.zeros(n + 1, U64)
        np.cumsum(values * up[:n], out=self.sum[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sum[ends] - self.sum[starts]) * self.down[starts])

    def windows(self, size: int) -> np.ndarray:
        """The hash of each run of `size` values, by its start."""
        n = len(self.sum) - size
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.sum[size:] - self.sum[:n]) * self.down[:n])


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of consecutive ranges, concatenated."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.cumsum(sizes) - sizes
    return np.repeat(starts - shift, sizes) + np.arange(total)


class KeyTable:
    """A growing map from 64-bit keys to row numbers: one large sorted run and one small one."""

    def __init__(self):
        self.size = 0
        self.runs = [(np.zeros(0, U64), np.zeros(0, np.int64)) for _ in range(2)]

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        for known, rows in self.runs:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                out[hit] = rows[at[hit]]
        return out

    def add(self, keys: np.ndarray) -> None:
        """New, distinct keys get the next row numbers."""
        rows = np.arange(self.size, self.size + len(keys))
        self.size += len(keys)
        small = (np.concatenate([self.runs[1][0], keys]), np.concatenate([self.runs[1][1], rows]))
        if len(small[0]) > max(1 << 14, len(self.runs[0][0]) >> 3):
            small = (np.concatenate([self.runs[0][0], small[0]]), np.concatenate([self.runs[0][1], small[1]]))
            order = np.argsort(small[0], kind="stable")
            self.runs = [(small[0][order], small[1][order]), (small[0][:0], small[1][:0])]
        else:
            order = np.argsort(small[0], kind="stable")
            self.runs[1] = (small[0][order], small[1][order])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
