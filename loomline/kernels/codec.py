"""The four verbs over one series: compress, decompress, extract and rebuild."""

from __future__ import annotations

import struct

import numpy as np

from ..methods import BIT_STREAMS, Method, SeriesError, corrupted, method_of, parse_config, unsupported
from . import lossless, pieces, segments, values
from .pieces import family_values, piece_values, walk_mix, walk_sim

M = Method
CONSTANTS = frozenset({M.PoorMansCompressionMidrange, M.PoorMansCompressionMean, M.PiecewiseConstantHistogram})
KNOTS = frozenset({M.SwingFilter, M.VisvalingamWhyatt, M.LargestTriangleThreeBuckets})
LINES = frozenset({M.SlideFilter, M.SwingFilterDisconnected, M.PiecewiseLinearHistogram, M.SlidingWindow, M.BottomUp, M.ABCLinearApproximation})
_INCLUSIVE = frozenset({M.SlidingWindow, M.BottomUp, M.ABCLinearApproximation, M.VisvalingamWhyatt, M.LargestTriangleThreeBuckets})
_PAIR, _TRIPLE = np.dtype([("v", "<f8"), ("e", "<u8")]), np.dtype([("a", "<f8"), ("b", "<f8"), ("e", "<u8")])


def model(x: np.ndarray, method: Method, c: dict) -> tuple[list[int], list[float]]:
    """(indices, coefficients) of the methods with a segment or term model."""
    if method in CONSTANTS:
        v, ends = segments.constant_histogram(x, c["histogram_bins_number"]) if method == M.PiecewiseConstantHistogram else (segments.midrange if method == M.PoorMansCompressionMidrange else segments.mean)(x, c["abs_error_bound"])
        return list(ends), list(v)
    if method == M.SwingFilter:
        s = segments.swing(x, c["abs_error_bound"], True)
        return [e for _, _, e in s], [s[0][0], *(b for _, b, _ in s)]
    if method in KNOTS:
        keep = segments.visvalingam(x, c["area_under_curve_error"]) if method == M.VisvalingamWhyatt else segments.lttb(x, c["target_point_count"])
        return keep[1:], x[keep].tolist()
    if method in LINES:
        if method == M.SlideFilter:
            s = segments.slide(x, c["abs_error_bound"])
        elif method == M.SwingFilterDisconnected:
            s = segments.swing(x, c["abs_error_bound"], False)
        elif method == M.PiecewiseLinearHistogram:
            s = segments.linear_histogram(x, c["histogram_bins_number"])
        elif method == M.ABCLinearApproximation:
            s = segments.strips(x, c["abs_error_bound"])
        else:
            s = (segments.sliding_window if method == M.SlidingWindow else segments.bottom_up)(x, c["aggregate_error_bound"])
        return [e for *_, e in s], [y for a, b, _ in s for y in (a, b)]
    if method in (M.SimPiece, M.MixPiece):
        tape = (pieces.sim_piece if method == M.SimPiece else pieces.mix_piece)(x, c["abs_error_bound"])
        return [int(y) for k, y in tape if k == "u"], [y for k, y in tape if k == "f"]
    if method == M.NonLinearApproximation:
        shift, s = pieces.nonlinear(x, c["abs_error_bound"])
        return [len(s), *(q[0] for q in s), *(q[3] for q in s)], [shift, *(y for q in s for y in q[1:3])]
    return values.fourier(x, c["number_of_coefficients"])


class _Streams:
    """Integers and doubles handed out in turn; what is taken is kept as bytes in that order."""

    def __init__(self, indices: list[int], coefficients: list[float]):
        self.u, self.f, self.i, self.j, self.kinds, self.taken = indices, coefficients, 0, 0, [], []

    def take_u(self) -> int:
        if self.i >= len(self.u):
            raise corrupted("too few indices")
        self.i += 1
        self.kinds.append("Q")
        self.taken.append(self.u[self.i - 1])
        return self.taken[-1]

    def take_f(self) -> float:
        if self.j >= len(self.f):
            raise corrupted("too few coefficients")
        self.j += 1
        self.kinds.append("d")
        self.taken.append(self.f[self.j - 1])
        return self.taken[-1]

    def bytes(self) -> bytes:
        return struct.pack("<" + "".join(self.kinds), *self.taken)


class _Bytes:
    def __init__(self, data: bytes):
        self.data, self.at, self.u, self.f = data, 0, [], []

    def _take(self, kind: str) -> float:
        if self.at + 8 > len(self.data):
            raise corrupted("the payload ends early")
        self.at += 8
        return struct.unpack_from(kind, self.data, self.at - 8)[0]

    def take_u(self) -> int:
        self.u.append(self._take("<Q"))
        return self.u[-1]

    def take_f(self) -> float:
        self.f.append(self._take("<d"))
        return self.f[-1]


def pack_model(method: Method, u: list[int], f: list[float]) -> bytes:
    """Payload without the method byte; the structure is checked."""
    if any(not 0 <= i < 1 << 63 for i in u):
        raise corrupted("an index is out of range")
    n = len(u)
    if method in CONSTANTS:
        if n != len(f) or not n:
            raise corrupted("lengths")
        out = np.empty(n, _PAIR)
        out["v"], out["e"] = f, u
        return out.tobytes()
    if method in KNOTS:
        if len(f) != n + 1:
            raise corrupted("lengths")
        out = np.empty(n, _PAIR)
        out["v"], out["e"] = f[1:], u
        return struct.pack("<d", f[0]) + out.tobytes()
    if method in LINES:
        if len(f) != 2 * n or not n:
            raise corrupted("lengths")
        out = np.empty(n, _TRIPLE)
        out["a"], out["b"], out["e"] = f[::2], f[1::2], u
        return out.tobytes()
    if method in (M.SimPiece, M.MixPiece):
        s = _Streams(u, f)
        (walk_sim if method == M.SimPiece else walk_mix)(s.take_u, s.take_f, lambda: s.j < len(f))
        if s.i != n or s.j != len(f):
            raise corrupted("something is left over")
        return s.bytes()
    if method == M.NonLinearApproximation:
        k = u[0] if n else 0
        if not k or n != 1 + 2 * k or len(f) != 1 + 2 * k or any(not 1 <= c <= 5 for c in u[1 : 1 + k]):
            raise corrupted("segments")
        codes = [*u[1 : 1 + k], 0]
        half = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, k, 2))
        out = np.empty(k, _TRIPLE)
        out["a"], out["b"], out["e"] = f[1::2], f[2::2], u[1 + k :]
        return struct.pack("<dQ", f[0], k) + half + out.tobytes()
    if n < 2 or len(f) != 1 + 2 * (n - 2) or u[0] != n - 1 or max(u[:2]) >= 1 << 32:
        raise corrupted("terms")
    return struct.pack("<IId", u[0], u[1], f[0]) + b"".join(struct.pack("<Qdd", k, f[1 + 2 * i], f[2 + 2 * i]) for i, k in enumerate(u[2:]))


def unpack_model(method: Method, data: bytes) -> tuple[list[int], list[float]]:
    if method in CONSTANTS or method in LINES:
        kind = _PAIR if method in CONSTANTS else _TRIPLE
        if not data or len(data) % kind.itemsize:
            raise corrupted("payload size")
        t = np.frombuffer(data, kind)
        return t["e"].tolist(), t["v"].tolist() if kind is _PAIR else np.stack([t["a"], t["b"]], axis=1).ravel().tolist()
    if method in KNOTS:
        if len(data) < 8 or (len(data) - 8) % 16:
            raise corrupted("payload size")
        t = np.frombuffer(data, _PAIR, offset=8)
        return t["e"].tolist(), [*struct.unpack_from("<d", data), *t["v"].tolist()]
    if method in (M.SimPiece, M.MixPiece):
        b = _Bytes(data)
        (walk_sim if method == M.SimPiece else walk_mix)(b.take_u, b.take_f, lambda: b.at + 8 < len(data))
        if b.at != len(data):
            raise corrupted("something is left over")
        return b.u, b.f
    if method == M.NonLinearApproximation:
        if len(data) < 16:
            raise corrupted("header")
        shift, k = struct.unpack_from("<dQ", data)
        half = -(-k // 2)
        if len(data) != 16 + half + 24 * k:
            raise corrupted("payload size")
        codes = [data[16 + i // 2] >> (0 if i & 1 else 4) & 15 for i in range(k)]
        t = np.frombuffer(data, _TRIPLE, offset=16 + half)
        return [k, *codes, *t["e"].tolist()], [shift, *np.stack([t["a"], t["b"]], axis=1).ravel().tolist()]
    if len(data) < 16 or (len(data) - 16) % 24:
        raise corrupted("payload size")
    k, n, mean = struct.unpack_from("<IId", data)
    terms = [struct.unpack_from("<Qdd", data, 16 + 24 * i) for i in range((len(data) - 16) // 24)]
    return [k, n, *(t[0] for t in terms)], [mean, *(y for t in terms for y in t[1:])]


def _spans(ends: list[int], inclusive: bool) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of disjoint segments."""
    stop = np.array(ends, dtype=np.int64) + int(inclusive)
    starts = np.r_[0, stop[:-1]]
    if not len(stop) or (stop <= starts).any() or stop[-1] >= 1 << 31:
        raise corrupted("segment ends")
    return starts, stop - starts


def model_values(method: Method, u: list[int], f: list[float]) -> np.ndarray:
    if any(i >= 1 << 62 for i in u):
        raise corrupted("an index is out of range")
    if method in CONSTANTS:
        return np.repeat(np.array(f), _spans(u, False)[1])
    if method in KNOTS:
        at = np.r_[0, np.array(u, dtype=np.int64) - (0 if method in _INCLUSIVE else 1)]
        if (np.diff(at) <= 0).any() or at[-1] >= 1 << 31:
            raise corrupted("segment ends")
        out = np.interp(np.arange(at[-1] + 1), at, f)
        out[at] = f
        return out
    if method in LINES:
        starts, n = _spans(u, method in _INCLUSIVE)
        a, b = np.repeat(f[::2], n), np.repeat(f[1::2], n)
        i, m = np.arange(int(n.sum())) - np.repeat(starts, n), np.repeat(n, n)
        chord = np.where(i == m - 1, b, a + (b - a) / np.maximum(m - 1, 1) * i)
        chord = np.where(i == 0, a, chord)
        if method != M.ABCLinearApproximation:
            return chord
        return np.where(m == 2, chord, a * np.arange(len(a)) + b)
    if method in (M.SimPiece, M.MixPiece):
        s = _Streams(u, f)
        return piece_values(*(walk_sim if method == M.SimPiece else walk_mix)(s.take_u, s.take_f, lambda: s.j < len(f)))
    if method == M.NonLinearApproximation:
        k = u[0]
        if any(not 1 <= c <= 5 for c in u[1 : 1 + k]):
            raise corrupted("function family")
        n = _spans(u[1 + k :], False)[1]
        return np.concatenate([family_values(c, f[1 + 2 * i], f[2 + 2 * i], int(n[i])) - f[0] for i, c in enumerate(u[1 : 1 + k])])
    return values.fourier_back(u, f)


_STREAMS = {
    M.BitPackedQuantization: (lambda x, c: values.quantize(x, c["abs_error_bound"]), values.quantize_back),
    M.RunLengthEncoding: (lambda x, c: lossless.rle(x), lossless.rle_back),
    M.SerfQT: (lambda x, c: values.serf(x, c["abs_error_bound"]), values.serf_back),
    M.BitPackedBUFF: (lambda x, c: values.buff(x, c["decimal_precision"]), values.buff_back),
    M.Chimp64: (lambda x, c: lossless.chimp64(x), lossless.chimp64_back),
    M.Chimp128: (lambda x, c: lossless.chimp128(x), lossless.chimp128_back),
    M.BitPackedDeltaEncoding: (lambda x, c: lossless.delta(x), lossless.delta_back),
    M.MacaqueS: (lambda x, c: values.macaque_s(x, c["abs_error_bound"]), values.macaque_s_back),
    M.MacaqueV: (lambda x, c: values.macaque_v(x, c["abs_error_bound"]), values.macaque_v_back),
    M.Elf: (lambda x, c: lossless.elf(x), lossless.elf_back),
}


def compress(series: np.ndarray, method: Method | int | str, config: dict | str | None = None) -> bytes:
    """Payload of a series, its last byte the method. An empty series gives no bytes; one value is stored raw."""
    method, x = method_of(method), np.ascontiguousarray(series, dtype="<f8")
    if len(x) == 0:
        return b""
    if len(x) == 1:
        return x.tobytes() + b"\0"
    c = parse_config(method, config)
    if method == M.Uncompressed:
        body = x.tobytes()
    elif method in _STREAMS:
        body = _STREAMS[method][0](x, c)
    else:
        body = pack_model(method, *model(x, method, c))
    return body + bytes([method])


def decompress(payload: bytes) -> np.ndarray:
    if not payload:
        return np.zeros(0)
    method, body = method_of(payload[-1]), payload[:-1]
    if method == M.Uncompressed:
        if len(body) % 8:
            raise corrupted("payload size")
        return np.frombuffer(body, "<f8")
    if method in _STREAMS:
        return _STREAMS[method][1](body)
    return model_values(method, *unpack_model(method, body))


def extract(payload: bytes) -> tuple[list[int], list[float]]:
    """(indices, coefficients) of a payload."""
    if len(payload) <= 8:
        raise unsupported("the payload is too short")
    method = method_of(payload[-1])
    if method in BIT_STREAMS:
        raise SeriesError("UnsupportedMethod", method.name)
    return unpack_model(method, payload[:-1])


def rebuild(indices: list[int], coefficients: list[float], method: Method | int | str) -> bytes:
    method = method_of(method)
    if not len(coefficients):
        raise unsupported("no coefficients")
    if method in BIT_STREAMS:
        raise SeriesError("UnsupportedMethod", method.name)
    return pack_model(method, [int(i) for i in indices], [float(x) for x in coefficients]) + bytes([method])
