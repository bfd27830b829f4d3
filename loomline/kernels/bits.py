"""Bit streams, most significant bit first, over Python integers and bytes."""

from __future__ import annotations

import struct

from ..methods import corrupted

MASK64 = (1 << 64) - 1


class BitWriter:
    """Collects bits in one integer and spills whole bytes now and then."""

    def __init__(self):
        self.done, self.word, self.n = bytearray(), 0, 0

    def put(self, value: int, bits: int) -> None:
        self.word = self.word << bits | value
        self.n += bits
        if self.n > 4096:
            keep = self.n & 7
            self.done += (self.word >> keep).to_bytes(self.n >> 3, "big")
            self.word, self.n = self.word & (1 << keep) - 1, keep

    def bytes(self) -> bytes:
        pad = -self.n % 8
        return bytes(self.done + (self.word << pad).to_bytes((self.n + pad) >> 3, "big"))


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def left(self) -> int:
        return self.end - self.at

    def get(self, bits: int) -> int:
        if bits > self.end - self.at:
            raise corrupted("the bit stream ends early")
        first, stop = self.at >> 3, (self.at + bits + 7) >> 3
        self.at += bits
        return int.from_bytes(self.data[first:stop], "big") >> (-self.at % 8) & ((1 << bits) - 1)


_DOUBLE, _WORD = struct.Struct("<d"), struct.Struct("<Q")


def bits_of(v: float, pack=_DOUBLE.pack, unpack=_WORD.unpack) -> int:
    return unpack(pack(v))[0]


def float_of(b: int, pack=_WORD.pack, unpack=_DOUBLE.unpack) -> float:
    return unpack(pack(b))[0]


def ordered(b: int) -> int:
    """Bits of a double as an unsigned integer in the order of the values."""
    return b ^ MASK64 if b >> 63 else b | 1 << 63


def unordered(o: int) -> int:
    return o & (1 << 63) - 1 if o >> 63 else o ^ MASK64


def zigzag(x: int) -> int:
    return x << 1 if x >= 0 else (-x << 1) - 1


def unzigzag(u: int) -> int:
    return -(u + 1 >> 1) if u & 1 else u >> 1


def put_gamma(w: BitWriter, u: int) -> None:
    """Elias gamma of u >= 1: as many zeros as u has bits after its first, then u."""
    w.put(u, 2 * u.bit_length() - 1)


def get_gamma(r: BitReader) -> int | None:
    """The next code; None if only padding zeros are left."""
    zeros = 0
    while True:
        if not r.left():
            if zeros < 8:
                return None
            raise corrupted("a gamma code ends early")
        if r.get(1):
            break
        zeros += 1
    return 1 << zeros | r.get(zeros)
