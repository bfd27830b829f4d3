"""Lossless bit-stream kernels: run lengths, packed decimal deltas and XOR codes."""

from __future__ import annotations

import math
import struct
from decimal import Decimal

import numpy as np

from ..methods import corrupted
from .bits import MASK64, BitReader, BitWriter, bits_of, float_of

# Fixed values of the XOR codes: leading zeros are cut down to one of eight steps.
LEADING_STEPS = (0, 8, 12, 16, 18, 20, 22, 24)
_STEP_OF = [max(i for i, s in enumerate(LEADING_STEPS) if s <= z) for z in range(65)]
_LEAST_TRAILING, _RING, _RING_BITS, _KEY_BITS = 6, 128, 7, 14


#: Bits that so many decimal places take.
_PLACE_BITS = [math.ceil(p * math.log2(10)) for p in range(21)]


def _trailing(x: int) -> int:
    return (x & -x).bit_length() - 1


def rle(values: np.ndarray) -> bytes:
    """(value, count) pairs of runs of equal values; a NaN equals nothing, so each is a run."""
    new = np.flatnonzero(np.r_[True, ~(values[1:] == values[:-1])])
    out = np.empty(len(new), dtype=[("v", "<f8"), ("n", "<u8")])
    out["v"], out["n"] = values[new], np.diff(np.r_[new, len(values)])
    return out.tobytes()


def rle_back(data: bytes) -> np.ndarray:
    if len(data) % 16:
        raise corrupted("runs are 16 bytes")
    runs = np.frombuffer(data, dtype=[("v", "<f8"), ("n", "<u8")])
    if (runs["n"] >= 1 << 31).any():
        raise corrupted("run length")
    return np.repeat(runs["v"], runs["n"].astype(np.int64))


class _XorCodes:
    """XOR of a value with an earlier one as window codes; one predecessor, or a ring of 128."""

    def __init__(self, ring: bool):
        self.ring, self.least = ring, _LEAST_TRAILING + (_RING_BITS if ring else 0)

    def encode(self, values: np.ndarray) -> bytes:
        raw = values.view(np.uint64).tolist()
        w, last_seen, window = BitWriter(), {raw[0] & (1 << _KEY_BITS) - 1: 0}, None
        for i in range(1, len(raw)):
            cur, ref, trailing = raw[i], i - 1, 0
            if self.ring:
                at = last_seen.get(cur & (1 << _KEY_BITS) - 1, 0)
                if i - 1 - at < _RING:
                    x = raw[at] ^ cur
                    trailing = _trailing(x) if x else 64
                    ref = at if trailing > self.least else ref
                last_seen[cur & (1 << _KEY_BITS) - 1] = i
            x = raw[ref] ^ cur
            slot, slot_bits = (ref % _RING, _RING_BITS) if self.ring else (0, 0)
            if not x:
                w.put(slot, 2 + slot_bits)
                window = None
                continue
            if not self.ring:
                trailing = _trailing(x)
            step = _STEP_OF[64 - x.bit_length()]
            body = 64 - LEADING_STEPS[step]
            if trailing > self.least:
                n = body - trailing
                w.put((((1 << slot_bits | slot) << 3 | step) << 6 | n) << n | x >> trailing, 2 + slot_bits + 9 + n)
                window = None
            elif step == window:
                w.put(0b10 << body | x, 2 + body)
            else:
                w.put((0b11 << 3 | step) << body | x, 5 + body)
                window = step
        w.put(1 << (9 + (_RING_BITS if self.ring else 0)), 11 + (_RING_BITS if self.ring else 0))
        return struct.pack("<d", values[0]) + w.bytes()

    def decode(self, data: bytes) -> np.ndarray:
        if len(data) < 8:
            raise corrupted("no first value")
        out, r, window = [int.from_bytes(data[:8], "little")], BitReader(data[8:]), 0
        while True:
            kind = r.get(2)
            ref = out[-1]
            if kind < 2 and self.ring:
                slot = r.get(_RING_BITS)
                back = (len(out) - 1 - slot) % _RING
                ref = out[len(out) - 1 - back] if back < len(out) else 0
            if kind == 0:
                out.append(ref)
                continue
            if kind == 1:
                step, n = r.get(3), r.get(6)
                if not n:
                    break
                if LEADING_STEPS[step] + n > 64:
                    raise corrupted("window")
                window = step
                out.append(ref ^ r.get(n) << (64 - LEADING_STEPS[step] - n))
                continue
            if kind == 3:
                window = r.get(3)
            out.append(ref ^ r.get(64 - LEADING_STEPS[window]))
        return np.array(out, dtype=np.uint64).view(np.float64)


chimp64, chimp64_back = _XorCodes(False).encode, _XorCodes(False).decode
chimp128, chimp128_back = _XorCodes(True).encode, _XorCodes(True).decode


def _decimal(v: float) -> tuple[int, int]:
    """(digits, exponent of the first digit) of the shortest decimal form of |v|."""
    whole, _, part = repr(abs(v)).partition(".")
    if part and "e" not in part and (whole != "0" or part != "0"):
        if whole != "0":
            return (len(whole.rstrip("0")) if part == "0" else len(whole) + len(part)), len(whole) - 1
        tail = part.lstrip("0")
        return len(tail), len(tail) - len(part) - 1
    _, digits, exponent = Decimal(repr(abs(v))).normalize().as_tuple()
    return len(digits), len(digits) + exponent - 1


def _first(a: float) -> int:
    """The power of ten at or below a positive double."""
    first = math.floor(math.log10(a))
    # close to a power of ten, or far out, the exact digits tell
    return first if -300 < first < 300 and 10.0**first * (1 + 1e-12) < a < 10.0 ** (first + 1) * (1 - 1e-12) else Decimal(a).adjusted()


def _erase(v: float) -> tuple[int | None, int]:
    """(digits to restore from, or None if nothing is erased; bits to store)."""
    raw = bits_of(v)
    if v == 0 or not math.isfinite(v):
        return None, raw
    digits, first = _decimal(v)
    places = digits - first - 1
    if not 0 <= places <= 20 or digits > 15:
        return None, raw
    kept = _PLACE_BITS[places] + (raw >> 52 & 0x7FF) - 1023
    cut = 52 - kept
    if not 4 < cut < 64:
        return None, raw
    short = raw >> cut << cut
    if short == raw:
        return None, raw
    mark = 0 if digits == 1 and first < 0 and abs(v) == float(f"1e{first}") else digits
    try:
        same = bits_of(_restore(float_of(short), mark)) == raw
    except ValueError:
        same = False
    return (mark, short) if same else (None, raw)


def _restore(v: float, digits: int) -> float:
    if v == 0 or not math.isfinite(v):
        raise corrupted("nothing to restore from")
    first = _first(abs(v))
    if digits == 0:
        return math.copysign(float(f"1e{first + 1}"), v)
    places = digits - first - 1
    if not 0 <= places <= 300:
        raise corrupted("decimal places")
    scale = 10.0**places
    return (math.floor(v * scale) if v < 0 else math.ceil(v * scale)) / scale


def elf(values: np.ndarray) -> bytes:
    w, prev, lead, trail = BitWriter(), bits_of(values[0]), None, 0
    for v in values[1:].tolist():
        mark, raw = _erase(v)
        w.put(0, 1) if mark is None else w.put(16 | mark, 5)
        x, prev = prev ^ raw, raw
        if not x:
            w.put(1, 2)
            continue
        step, t = _STEP_OF[64 - x.bit_length()], _trailing(x)
        if lead is not None and LEADING_STEPS[step] == lead and t >= trail:
            w.put(x >> trail, 2 + 64 - lead - trail)
            continue
        lead, trail = LEADING_STEPS[step], t
        n = 64 - lead - trail
        # the last bit of the window is one, so it is not stored
        if n <= 16:
            w.put(((2 << 3 | step) << 4 | n & 15) << (n - 1) | x >> (t + 1), 9 + n - 1)
        else:
            w.put(((3 << 3 | step) << 6 | n & 63) << (n - 1) | x >> (t + 1), 11 + n - 1)
    w.put(0b011111 << 6, 12)
    return struct.pack("<d", values[0]) + w.bytes()


def elf_back(data: bytes) -> np.ndarray:
    if len(data) < 8:
        raise corrupted("no first value")
    first = int.from_bytes(data[:8], "little")
    out, r, prev, lead, trail = [float_of(first)], BitReader(data[8:]), first, None, 0
    while True:
        mark = r.get(4) if r.get(1) else None
        kind = r.get(2)
        if kind == 0:
            if lead is None:
                raise corrupted("no window")
            x = r.get(64 - lead - trail) << trail
            if not x:
                raise corrupted("empty window")
        elif kind == 1:
            x = 0
        else:
            step, n = r.get(3), r.get(4 if kind == 2 else 6)
            if kind == 3 and step == 7 and n == 0:
                if mark is not None:
                    raise corrupted("end within a value")
                break
            n = n or (16 if kind == 2 else 64)
            if LEADING_STEPS[step] + n > 64:
                raise corrupted("window")
            lead, trail = LEADING_STEPS[step], 64 - LEADING_STEPS[step] - n
            x = (r.get(n - 1) << 1 | 1) << trail
        prev ^= x
        out.append(float_of(prev) if mark is None else _restore(float_of(prev), mark))
    return np.array(out)


#: Widths of packed unsigned integers by their two-bit tag.
WIDTHS = (8, 16, 32, 64)


def put_tagged(w: BitWriter, u: int) -> None:
    tag = 0 if u < 1 << 8 else 1 if u < 1 << 16 else 2 if u < 1 << 32 else 3
    w.put(tag << WIDTHS[tag] | u, 2 + WIDTHS[tag])


def _scaled(values: list[float]) -> tuple[float, list[int | None]]:
    """(power of ten, scaled integers; None for values that it does not give back exactly)."""
    places = max((max(0, d - f - 1) for v in values if v and math.isfinite(v) for d, f in [_decimal(v)] if d <= 15), default=0)
    scale = 10.0 ** min(places, 15)
    out: list[int | None] = []
    for v in values:
        s = round(v * scale) if math.isfinite(v) and abs(v * scale) < 1 << 53 else None
        out.append(s if s is not None and s / scale == v and (v != 0 or math.copysign(1, v) > 0) else None)
    return scale, out


def delta(values: np.ndarray) -> bytes:
    """Decimal-scaled integers as packed differences; values that do not scale exactly go raw at the end."""
    raw = values.tolist()
    scale, ints = _scaled(raw)
    good = [x for x in ints if x is not None]
    mixed = len(good) < len(raw)
    out = [struct.pack("<Id", len(raw) | (0 if mixed else 1 << 31), scale)]
    if mixed:
        mask = np.packbits(np.array([x is not None for x in ints]), bitorder="little").tobytes()
        out.append(struct.pack("<I", len(good)) + mask)
    if good:
        steps = [b - a for a, b in zip(good, good[1:])]
        least = min(steps, default=0)
        w = BitWriter()
        for d in steps:
            put_tagged(w, d - least)
        out.append(struct.pack("<qq", good[0], least) + w.bytes())
    out.append(b"".join(struct.pack("<d", v) for v, x in zip(raw, ints) if x is None))
    return b"".join(out)


def delta_back(data: bytes) -> np.ndarray:
    if len(data) < 12:
        raise corrupted("header")
    head, scale = struct.unpack_from("<Id", data)
    n, mixed, at = head & (1 << 31) - 1, not head >> 31, 12
    good, mask = n, None
    if mixed:
        size = -(-n // 8)
        if len(data) < 16 + size:
            raise corrupted("mask")
        good = struct.unpack_from("<I", data, 12)[0]
        mask = np.unpackbits(np.frombuffer(data, np.uint8, size, 16), bitorder="little")[:n].astype(bool)
        at = 16 + size
        if int(mask.sum()) != good:
            raise corrupted("mask")
    raw_bytes = 8 * (n - good)
    ints = []
    if good:
        if len(data) < at + 16 + raw_bytes:
            raise corrupted("values")
        first, least = struct.unpack_from("<qq", data, at)
        r = BitReader(data[at + 16 : len(data) - raw_bytes])
        ints = [first]
        for _ in range(good - 1):
            ints.append(ints[-1] + least + r.get(WIDTHS[r.get(2)]))
    scaled = np.array([i / scale for i in ints])
    if not mixed:
        return scaled
    out = np.empty(n)
    out[mask], out[~mask] = scaled, np.frombuffer(data, "<f8", n - good, len(data) - raw_bytes)
    return out


__all__ = ["MASK64", "rle", "rle_back", "chimp64", "chimp64_back", "chimp128", "chimp128_back", "elf", "elf_back", "delta", "delta_back", "put_tagged", "WIDTHS"]
