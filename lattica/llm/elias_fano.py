"""Elias-Fano coding of non-decreasing integers, with select.

n values below u take n * floor(log2(u / n)) low bits and at most 3n high bits.
Bit v >> low, counted with the value's rank, is set in the high bits; every
64th set bit's place is kept in 32 bits, from where select() scans.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QBII")
_STEP = 64


def _pack(values: np.ndarray, width: int) -> bytes:
    if not width or not len(values):
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def encode(values: np.ndarray) -> bytes:
    """Bytes of a non-decreasing array of integers from 0."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    low = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
    parts = [_pack(values[a : a + 65536] & np.uint64((1 << low) - 1), low) for a in range(0, n, 65536)]
    places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
    high[places] = 1
    packed = np.packbits(high, bitorder="little").tobytes()
    return _HEAD.pack(n, low, len(packed), sum(map(len, parts))) + b"".join(parts) + packed + places[::_STEP].astype("<u4").tobytes()


class EliasFano:
    """Reads what encode() wrote."""

    def __init__(self, data: bytes):
        self.n, self.low, n_high, n_low = _HEAD.unpack_from(data)
        at = _HEAD.size
        self.lows = np.frombuffer(data, np.uint8, n_low, at)
        self.high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        self.samples = np.frombuffer(data, "<u4", -(-self.n // _STEP), at + n_low + n_high)
        self.size = at + n_low + n_high + self.samples.nbytes

    def _low(self, first: int, count: int) -> np.ndarray:
        if not self.low:
            return np.zeros(count, np.uint64)
        a, b = first * self.low, (first + count) * self.low
        bits = np.unpackbits(self.lows[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a]
        weights = np.uint64(1) << np.arange(self.low, dtype=np.uint64)
        return (bits.reshape(count, self.low) * weights).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The i-th value, from 0."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // _STEP]), i % _STEP
        at = place // 8
        skip = place % 8
        while True:
            bits = np.unpackbits(self.high[at : at + 64], bitorder="little")
            bits[:skip] = 0
            ones = np.flatnonzero(bits)
            if left < len(ones):
                place = at * 8 + int(ones[left])
                return ((place - i) << self.low) | int(self._low(i, 1)[0])
            left, at, skip = left - len(ones), at + 64, 0

    def values(self) -> np.ndarray:
        """All values."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little")).astype(np.uint64)
        lows = [self._low(a, min(65536, self.n - a)) for a in range(0, self.n, 65536)]
        return ((places - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low)) | (np.concatenate(lows) if lows else np.zeros(0, np.uint64))
