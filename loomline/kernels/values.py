"""Value-representation kernels: quantised, fixed-point and shortened values, and Fourier terms."""

from __future__ import annotations

import math
import struct

import numpy as np

from ..methods import MAX_ABS_VALUE, corrupted, invalid, unsupported
from .bits import BitReader, BitWriter, bits_of, float_of, get_gamma, ordered, put_gamma, unordered, unzigzag, zigzag
from .lossless import WIDTHS, put_tagged


def bucket(bound: float) -> float:
    """Width of a quantisation step: a little under twice the bound, in single precision."""
    return float(np.float32(1.998) * np.float32(bound))


def check_range(values: np.ndarray) -> None:
    if not np.isfinite(values).all() or (np.abs(values) > MAX_ABS_VALUE).any():
        raise unsupported("values must be finite and of moderate size")


def round_half_away(x: np.ndarray) -> np.ndarray:
    return np.copysign(np.floor(np.abs(x) + 0.5), x)


def quantize(values: np.ndarray, bound: float) -> bytes:
    check_range(values)
    w = BitWriter()
    if bound == 0:
        keys = [ordered(b) for b in values.view(np.uint64).tolist()]
        least, step = float_of(unordered(min(keys))), 0.0
        codes = [k - min(keys) for k in keys]
    else:
        least, step = float(values.min()), bucket(bound)
        q = round_half_away((values - least) / step)
        if (q >= 2.0**63).any() or (np.abs(least + q * step - values) > bound).any():
            raise unsupported("the grid is too coarse for the bound")
        codes = q.astype(np.int64).tolist()
    for c in codes:
        put_tagged(w, c)
    return struct.pack("<dd", least, step) + w.bytes()


def quantize_back(data: bytes) -> np.ndarray:
    if len(data) < 16:
        raise corrupted("header")
    least, step = struct.unpack_from("<dd", data)
    r, codes = BitReader(data[16:]), []
    while r.left() >= 10:
        n = WIDTHS[r.get(2)]
        if n > r.left():
            raise corrupted("a code ends early")
        codes.append(r.get(n))
    if step == 0:
        base = ordered(bits_of(least))
        return np.array([float_of(unordered(base + c & (1 << 64) - 1)) for c in codes])
    return least + np.array(codes, dtype=np.float64) * step


def serf(values: np.ndarray, bound: float) -> bytes:
    check_range(values)
    w, step, p = BitWriter(), bucket(bound), 0.0
    last = ordered(0)
    for v in values.tolist():
        if bound == 0:
            now = ordered(bits_of(v))
            put_gamma(w, zigzag(now - last) + 1)
            last = now
            continue
        x = (v - p) / step
        q = int(math.copysign(math.floor(abs(x) + 0.5), x)) if abs(x) < 2.0**63 else None
        if q is None or abs(v - (p + q * step)) > bound:
            raise unsupported("the bound is too small for the values")
        put_gamma(w, zigzag(q) + 1)
        p += q * step
    return struct.pack("<d", step) + w.bytes()


def serf_back(data: bytes) -> np.ndarray:
    if len(data) < 8:
        raise corrupted("header")
    (step,), r, out, p, last = struct.unpack_from("<d", data), BitReader(data[8:]), [], 0.0, ordered(0)
    while (u := get_gamma(r)) is not None:
        q = unzigzag(u - 1)
        if step == 0:
            last = last + q & (1 << 64) - 1
            out.append(float_of(unordered(last)))
        else:
            p += q * step
            out.append(p)
    return np.array(out)


#: Bits of the fraction for 1 to 10 decimal places.
FRACTION_BITS = (5, 8, 11, 15, 18, 21, 25, 28, 31, 35)


def buff(values: np.ndarray, places: int) -> bytes:
    size = np.abs(values)
    if not np.isfinite(values).all() or (size >= 2.0**53).any() or ((size < 2.0**-64) & (size > 0)).any():
        raise unsupported("values must be finite, of moderate size")
    fb = FRACTION_BITS[places - 1]
    whole = np.floor(size)
    frac = np.floor((size - whole) * 2.0**fb).astype(np.int64).tolist()
    ints, sign = whole.astype(np.int64), np.signbit(values).tolist()
    base = ints - ints.min()
    steps = [zigzag(int(d)) for d in np.diff(base)]
    ib = max(1, max((s.bit_length() for s in steps), default=1))
    w = BitWriter()
    w.put(frac[0] << 1 | sign[0], fb + 1)
    for s, f, g in zip(steps, frac[1:], sign[1:]):
        w.put((s << fb | f) << 1 | g, ib + fb + 1)
    return struct.pack("<BBIQQ", fb, ib, len(values), int(ints.min()), int(base[0])) + w.bytes()


def buff_back(data: bytes) -> np.ndarray:
    if len(data) < 22:
        raise corrupted("header")
    fb, ib, n, least, at = struct.unpack_from("<BBIQQ", data)
    if fb > 53 or ib > 64 or 8 * (len(data) - 22) < n * (fb + 1) + max(0, n - 1) * ib:
        raise corrupted("header")
    r, out = BitReader(data[22:]), []
    for i in range(n):
        at += unzigzag(r.get(ib)) if i else 0
        v = least + at + r.get(fb) / 2.0**fb
        out.append(-v if r.get(1) else v)
    return np.array(out)


def shorten(v: float, bound: float) -> tuple[int, int]:
    """(mantissa bits kept, bits of the value cut off after them) so that the error is within the bound."""
    raw = bits_of(v)
    if bound == 0 or not math.isfinite(v):
        return 52, raw
    share = bound / 2.0 ** ((raw >> 52 & 0x7FF) - 1023) if raw >> 52 & 0x7FF else math.inf
    keep = 52 if share <= 0 else 0 if share >= 1 else min(52, math.floor(-math.log2(share)))
    while abs(float_of(raw >> 52 - keep << 52 - keep) - v) > bound:
        keep += 1
    return keep, raw >> 52 - keep << 52 - keep


def _put_short(w: BitWriter, keep: int, raw: int) -> None:
    w.put(keep << 12 + keep | raw >> 52 - keep, 18 + keep)


def _get_short(r: BitReader) -> int | None:
    """The next shortened value; None if only padding is left."""
    if r.left() < 18:
        if r.left() and r.get(r.left()):
            raise corrupted("a value ends early")
        return None
    keep = r.get(6)
    if keep > 52:
        raise corrupted("mantissa bits")
    return r.get(12 + keep) << 52 - keep


def macaque_s(values: np.ndarray, bound: float) -> bytes:
    w = BitWriter()
    for v in values.tolist():
        _put_short(w, *shorten(v, bound))
    return w.bytes()


def macaque_s_back(data: bytes) -> np.ndarray:
    r, out = BitReader(data), []
    while (raw := _get_short(r)) is not None:
        out.append(raw)
    return np.array(out, dtype=np.uint64).view(np.float64)


def macaque_v(values: np.ndarray, bound: float) -> bytes:
    """As macaque_s, but a value within the bound of the last one stored repeats it, others are XORed with it."""
    w = BitWriter()
    keep, last = shorten(float(values[0]), bound)
    _put_short(w, keep, last)
    lead, trail = (64 - last.bit_length(), (last & -last).bit_length() - 1) if last else (64, 0)
    for v in values[1:].tolist():
        held = float_of(last)
        if bits_of(v) == last if bound == 0 else math.isfinite(v) and math.isfinite(held) and abs(v - held) <= bound:
            w.put(0, 1)
            continue
        raw = shorten(v, bound)[1]
        x, last = raw ^ last, raw
        if not x:
            w.put(0, 1)
            continue
        a, b = 64 - x.bit_length(), (x & -x).bit_length() - 1
        if a >= lead and b >= trail:
            w.put(0b10 << 64 - lead - trail | x >> trail, 2 + 64 - lead - trail)
            continue
        lead, trail = a, b
        n = 64 - a - b
        w.put(((0b11 << 6 | a) << 6 | n & 63) << n | x >> b, 14 + n)
    w.put(0b11 << 12 | 63 << 6, 14)
    return w.bytes()


def macaque_v_back(data: bytes) -> np.ndarray:
    r = BitReader(data)
    last = _get_short(r)
    if last is None:
        raise unsupported("no first value")
    out, (lead, trail) = [last], (64 - last.bit_length(), (last & -last).bit_length() - 1) if last else (64, 0)
    while True:
        if r.get(1):
            if r.get(1):
                a, n = r.get(6), r.get(6)
                if a == 63 and n == 0:
                    break
                n = n or 64
                if a + n > 64:
                    raise corrupted("window")
                lead, trail = a, 64 - a - n
            last ^= r.get(64 - lead - trail) << trail
        out.append(last)
    return np.array(out, dtype=np.uint64).view(np.float64)


def fourier(values: np.ndarray, terms: int) -> tuple[list[int], list[float]]:
    """(K, N, frequencies; mean, then real and imaginary parts) of the strongest terms; lower frequencies win ties."""
    n = len(values)
    if terms > n // 2 + 1:
        raise invalid("more terms than the series has")
    c = np.fft.rfft(values)
    power = c.real**2 + c.imag**2
    pick = np.sort(np.argsort(-power[1:], kind="stable")[: terms - 1]) + 1
    return [terms, n, *pick.tolist()], [float(c[0].real), *(float(x) for k in pick for x in (c[k].real, c[k].imag))]


def fourier_back(indices: list[int], coefficients: list[float]) -> np.ndarray:
    n, freq = indices[1], indices[2:]
    if any(not 0 < k <= n // 2 for k in freq) or len(coefficients) != 1 + 2 * len(freq):
        raise corrupted("terms")
    c = np.zeros(n // 2 + 1, dtype=np.complex128)
    c[0] = coefficients[0]
    for i, k in enumerate(freq):
        c[k] = complex(coefficients[1 + 2 * i], coefficients[2 + 2 * i])
    return np.fft.irfft(c, n)
