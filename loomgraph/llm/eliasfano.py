"""Elias-Fano coding of non-decreasing sequences, with a sampled select structure."""

import struct

import numpy as np

#: every SAMPLE-th set bit's position is stored
SAMPLE = 512
HEADER = "<4sBxxxQQQ"  # magic, low bits, count, universe, bytes of the high part


def encode(values) -> bytes:
    """Bytes of a non-decreasing sequence of non-negative integers.

    Each value's low bits are packed; its high part is a set bit at high + index in a bit
    vector, so that n values below u take about n * (2 + log2(u / n)) bits.
    """
    v = np.asarray(values, np.uint64)
    n = len(v)
    top = int(v[-1]) if n else 0
    bits = max(0, (top // max(n, 1)).bit_length() - 1) if n else 0
    low = v & np.uint64((1 << bits) - 1)
    packed = np.packbits(((low[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes() if bits else b""
    where = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
    size = int(where[-1]) + 1 if n else 0
    flags = np.zeros((size + 7) // 8 * 8, np.uint8)
    flags[where] = 1
    high = np.packbits(flags, bitorder="little").tobytes()
    return struct.pack(HEADER, b"EFS1", bits, n, top + 1, len(high)) + packed + high + where[::SAMPLE].astype("<u4").tobytes()


class EliasFano:
    """Reader over ``encode``'s bytes: item i, or all items, without a table of offsets."""

    def __init__(self, data, at=0):
        magic, self.bits, self.n, self.universe, size = struct.unpack_from(HEADER, data, at)
        if magic != b"EFS1":
            raise ValueError("not an Elias-Fano sequence")
        at += struct.calcsize(HEADER)
        low = (self.n * self.bits + 7) // 8
        self.low = np.frombuffer(data, np.uint8, low, at)
        self.high = np.frombuffer(data, np.uint8, size, at + low)
        samples = (self.n + SAMPLE - 1) // SAMPLE
        self.samples = np.frombuffer(data, "<u4", samples, at + low + size)
        self.end = at + low + size + 4 * samples

    def __len__(self):
        return self.n

    def select(self, i):
        """Position of set bit i: from its sample, a scan of at most SAMPLE set bits."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, skip = at // 8, at % 8
        while True:
            piece = self.high[byte : byte + 256]
            counts = np.bitwise_count(piece).astype(np.int64)
            if skip:
                counts[0] = int(np.bitwise_count(np.uint8(piece[0] >> skip)))
            total = np.cumsum(counts)
            k = int(np.searchsorted(total, left, side="right"))
            if k < len(piece):
                left -= int(total[k - 1]) if k else 0
                value = int(piece[k]) >> (skip if k == 0 else 0)
                bit = skip if k == 0 else 0
                while True:
                    if value & 1:
                        if left == 0:
                            return (byte + k) * 8 + bit
                        left -= 1
                    value >>= 1
                    bit += 1
            left -= int(total[-1])
            byte, skip = byte + 256, 0

    def __getitem__(self, i):
        low = 0
        for b in range(self.bits):
            at = i * self.bits + b
            low |= ((int(self.low[at >> 3]) >> (at & 7)) & 1) << b
        return ((self.select(i) - i) << self.bits) | low

    def all(self):
        where = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (where - np.arange(self.n)).astype(np.int64)
        if not self.bits:
            return high
        low = np.unpackbits(self.low, bitorder="little")[: self.n * self.bits].reshape(self.n, self.bits).astype(np.int64)
        return (high << self.bits) | (low << np.arange(self.bits)).sum(axis=1)
