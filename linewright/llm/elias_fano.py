"""Elias-Fano lists: non-decreasing numbers in near-minimal space with direct access."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QQBQ")
#: One position in the high bits is kept for so many list elements.
EVERY = 512


def encode(values: np.ndarray) -> bytes:
    """``values`` are non-decreasing and from 0.

    With n values up to u, the low ``log2(u / n)`` bits of each are packed one after the other.
    The rest is a bit string in which value i sets bit ``(value >> low) + i``, about two bits a
    value. Every ``EVERY``-th set position is kept in 32 bits, relative to the start
    of the string, for select.
    """
    values = np.asarray(values, dtype=np.int64)
    n = len(values)
    if n == 0:
        return _HEAD.pack(0, 0, 0, 0)
    top = int(values[-1])
    low = max(0, (max(top, 1) // n).bit_length() - 1)
    ones = (values >> low) + np.arange(n)
    bits = np.zeros(int(ones[-1]) + 1, dtype=np.uint8)
    bits[ones] = 1
    lows = ((values[:, None] >> np.arange(low)) & 1).astype(np.uint8) if low else np.zeros((n, 0), np.uint8)
    if len(bits) >= 1 << 32:
        raise ValueError("split the list: a select sample holds 32 bits")
    return b"".join(
        (
            _HEAD.pack(n, top, low, len(bits)),
            np.packbits(lows.reshape(-1), bitorder="little").tobytes(),
            np.packbits(bits, bitorder="little").tobytes(),
            ones[::EVERY].astype("<u4").tobytes(),
        )
    )


class EliasFano:
    """Reads an encoded list; ``get(i)`` looks at one value without decoding the others."""

    def __init__(self, data: bytes):
        self.n, self.top, self.low, n_bits = _HEAD.unpack_from(data)
        at = _HEAD.size
        n_low = (self.n * self.low + 7) // 8
        n_high = (n_bits + 7) // 8
        self._lows = np.frombuffer(data, np.uint8, n_low, at)
        self._high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        n_samples = (self.n + EVERY - 1) // EVERY
        self._samples = np.frombuffer(data, "<u4", n_samples, at + n_low + n_high)
        self.size = at + n_low + n_high + 4 * n_samples

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """Position of set bit ``i`` in the high bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        position = int(self._samples[i // EVERY])
        rest = i % EVERY
        byte = position // 8
        # Bits below the sampled one do not count.
        window = np.unpackbits(self._high[byte : byte + 1], bitorder="little")
        window[: position % 8] = 0
        while rest >= (found := int(window.sum())):
            rest -= found
            byte += 1
            window = np.unpackbits(self._high[byte : byte + 1], bitorder="little")
        return byte * 8 + int(np.flatnonzero(window)[rest])

    def get(self, i: int) -> int:
        high = self.select(i) - i
        value = 0
        for bit in range(self.low):
            at = i * self.low + bit
            value |= (int(self._lows[at >> 3]) >> (at & 7) & 1) << bit
        return high << self.low | value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Values ``start`` to ``stop`` - 1, decoded together."""
        stop = min(stop, self.n)
        if start >= stop:
            return np.zeros(0, dtype=np.int64)
        first, last = self.select(start), self.select(stop - 1)
        bits = np.unpackbits(self._high[first // 8 : last // 8 + 1], bitorder="little")
        ones = np.flatnonzero(bits) + (first // 8) * 8
        ones = ones[(ones >= first) & (ones <= last)]
        highs = ones - np.arange(start, stop)
        a, b = start * self.low, stop * self.low
        packed = np.unpackbits(self._lows[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a]
        lows = packed.reshape(stop - start, self.low).astype(np.int64) @ (1 << np.arange(self.low, dtype=np.int64))
        return highs << self.low | lows
