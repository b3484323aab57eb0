"""Elias-Fano sequences in numpy, and flat files of arrays that are memory-mapped."""

from __future__ import annotations

import json
import os
import uuid

import numpy as np


_1, _2, _4, _LAST = (np.uint64(x) for x in (1, 2, 4, 255))
_PAIRS, _FOURS, _BYTES, _ONES, _HIGH = (np.uint64(x) for x in (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0x0101010101010101, 0x8080808080808080))
#: Place of the k-th set bit of a byte.
_PLACE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.int64)


def _pack(bits: np.ndarray) -> np.ndarray:
    """0/1 bytes to little-endian 64-bit words, with one spare word."""
    b = np.packbits(bits, bitorder="little")
    out = np.zeros((len(b) + 7) // 8 + 1, np.uint64)
    out.view(np.uint8)[:len(b)] = b
    return out


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary with a count of zeros per word.

    All operations take arrays. ``arrays`` and :meth:`load` give and take the parts, so that a
    sequence can live in a memory-mapped file.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.zeros = n, low_bits, low, high, zeros

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> "EliasFano":
        v = np.asarray(values, np.uint64)
        n = len(v)
        bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        parts = []
        if bits:
            for a in range(0, n, 1 << 17):
                x = np.ascontiguousarray(v[a:a + (1 << 17)].astype("<u8")).view(np.uint8).reshape(-1, 8)
                parts.append(np.unpackbits(x, axis=1, bitorder="little")[:, :bits].ravel())
        low = _pack(np.concatenate(parts) if parts else np.zeros(0, np.uint8))
        h = (v >> np.uint64(bits)).astype(np.int64)
        unary = np.zeros(n + (int(h[-1]) if n else 0) + 2, np.uint8)
        unary[h + np.arange(n)] = 1
        # bits after the end count as zeros, so that every bucket up to the last is closed
        high = _pack(unary)
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))])
        return cls(n, bits, low, high, zeros)

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.head": np.array([self.n, self.low_bits], np.int64), f"{name}.low": self.low, f"{name}.high": self.high,
                f"{name}.zeros": self.zeros.astype(np.uint32 if self.zeros[-1] < 1 << 32 else np.int64)}

    @classmethod
    def load(cls, parts: dict[str, np.ndarray], name: str) -> "EliasFano":
        n, bits = (int(x) for x in parts[f"{name}.head"])
        return cls(n, bits, parts[f"{name}.low"], parts[f"{name}.high"], parts[f"{name}.zeros"])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        x = self.low[word] >> off
        with np.errstate(over="ignore"):
            up = np.where(off > 0, self.low[np.minimum(word + 1, len(self.low) - 1)] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        return (x | up) & np.uint64((1 << self.low_bits) - 1)

    @staticmethod
    def _nth(word: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Place of the r-th set bit of each word: sums of bits up to each byte give the byte, a table the place in it."""
        r = r.astype(np.uint64)
        with np.errstate(over="ignore"):
            s = word - ((word >> _1) & _PAIRS)
            s = (s & _FOURS) + ((s >> _2) & _FOURS)
            s = ((s + (s >> _4)) & _BYTES) * _ONES
            at = np.bitwise_count(((r * _ONES) | _HIGH) - s & _HIGH).astype(np.uint64) << np.uint64(3)
            rest = (r - (((s << np.uint64(8)) >> at) & _LAST)).astype(np.int64)
        return at.astype(np.int64) + _PLACE[((word >> at) & _LAST).astype(np.int64), rest]

    def _select0(self, k: np.ndarray) -> np.ndarray:
        w = np.searchsorted(self.zeros, k, side="right") - 1
        inside = w < len(self.high)
        w_ = np.minimum(w, len(self.high) - 1)
        p = w_ * 64 + self._nth(~self.high[w_], k - self.zeros[w_].astype(np.int64))
        return np.where(inside, p, len(self.high) * 64 + (k - int(self.zeros[-1])))

    def _select1(self, k: np.ndarray) -> np.ndarray:
        ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros
        w = np.searchsorted(ones, k, side="right") - 1
        return w * 64 + self._nth(self.high[w], k - ones[w])

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return ((self._select1(i) - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def find(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Index of each value, searched for its successor within [lo, hi); -1 where it does not occur."""
        x = np.asarray(x, np.uint64)
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        h = (x >> np.uint64(self.low_bits)).astype(np.int64)
        before = np.where(h > 0, self._select0(np.maximum(h - 1, 0)), -1)  # the zero that closes the bucket before
        a = before - h + 1
        # the bucket's ones follow; only a run that fills its word asks for the next zero
        w = np.minimum((before + 1) >> 6, len(self.high) - 1)
        free = ~self.high[w] >> ((before + 1) & 63).astype(np.uint64)
        with np.errstate(over="ignore"):
            b = a + np.bitwise_count((free & (~free + _1)) - _1)
        odd = np.nonzero((free == 0) | ((before + 1) >> 6 >= len(self.high)))[0]
        if len(odd):
            b[odd] = self._select0(h[odd]) - h[odd]
        a, b = np.minimum(a, self.n), np.minimum(b, self.n)
        if lo is not None:
            a, b = np.maximum(a, lo), np.minimum(b, hi)
        end, want = b.copy(), x & np.uint64((1 << self.low_bits) - 1)
        live = np.nonzero(a < b)[0]
        while len(live):
            m = (a[live] + b[live]) >> 1
            less = self._low(m) < want[live]
            a[live] = np.where(less, m + 1, a[live])
            b[live] = np.where(less, b[live], m)
            live = live[a[live] < b[live]]
        at = np.nonzero(a < end)[0]
        hit = at[self._low(a[at]) == want[at]]
        out[hit] = a[hit]
        return out


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays to one file under another name and move it into place, so retries and copies of a task do no harm."""
    head, at = {}, 0
    for k, v in arrays.items():
        head[k] = [v.dtype.str, len(v), at]
        at += -(-v.nbytes // 8) * 8
    top = json.dumps(head).encode()
    top += b" " * (-len(top) % 8)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(len(top).to_bytes(8, "little") + top)
        for v in arrays.values():
            f.write(v.tobytes() + b"\0" * (-v.nbytes % 8))
    os.replace(part, path)


def load(path: str) -> dict[str, np.ndarray]:
    data = np.asarray(np.memmap(path, np.uint8, "r"))  # a plain view: the memmap class costs more on every slice
    n = int.from_bytes(bytes(data[:8]), "little")
    out = {}
    for k, (kind, count, at) in json.loads(bytes(data[8:8 + n])).items():
        a = 8 + n + at
        out[k] = data[a:a + count * np.dtype(kind).itemsize].view(kind) if count else np.zeros(0, kind)
    return out
