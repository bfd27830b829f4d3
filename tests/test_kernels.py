"""Kernels: round trips, bounds, golden vectors, structure checks."""

import math
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.kernels import codec, lossless, segments
from loomline.kernels.bits import BitReader, BitWriter, get_gamma, put_gamma, unzigzag, zigzag
from loomline.kernels.geometry import Stabber, extend_hull, longest_line, strip_line
from loomline.methods import FIELDS, Method, SeriesError, bound32, parse_config

M = Method
LOSSLESS = [M.Uncompressed, M.RunLengthEncoding, M.Chimp64, M.Chimp128, M.BitPackedDeltaEncoding, M.Elf]
BOUNDED = [m for m, f in FIELDS.items() if "abs_error_bound" in f]
MODELS = [m for m in M if m not in codec.BIT_STREAMS]
SPECIAL = np.array([1, np.nan, np.inf, -np.inf, 1.7976931348623157e308, -0.0, 0.0, 5e-324, 2.2250738585072014e-308, 0.1, 3.17, 100.01, -42.42, 1e-5, 1e-10, 123456789.123])


def config(m, bound=0.5):
    kinds = {"bound": bound, "text": "rmse", "precision": 4}
    return {k: kinds.get(t, 2 if k == "number_of_coefficients" else 5) for k, t in FIELDS.get(m, {}).items()}


def series():
    r, i = np.random.default_rng(3), np.arange(130)
    return {"line": 3.2 * i + 7 + r.normal(0, 1, 130), "sine": 50 * np.sin(i / 9) + r.normal(0, 0.2, 130), "walk": np.cumsum(r.normal(0, 1, 130)), "decimal": np.round(r.uniform(0, 490, 131), 2), "constant": np.full(40, 7.25), "mixed": np.r_[np.exp(i / 30), np.sqrt(i) * 9, -i * 2.0], "two": np.array([1.0, 5.0]), "three": np.array([1.0, 2.08, 2.96])}


@pytest.mark.parametrize("m", LOSSLESS)
@pytest.mark.parametrize("name", series())
def test_lossless(m, name):
    x = series()[name]
    assert (codec.decompress(codec.compress(x, m, {})).view(np.uint64) == x.view(np.uint64)).all()


@pytest.mark.parametrize("m", [M.Chimp64, M.Chimp128, M.Elf, M.BitPackedDeltaEncoding, M.MacaqueS, M.MacaqueV, M.Uncompressed])
def test_bitwise(m):
    y = codec.decompress(codec.compress(SPECIAL, m, config(m, 0.0)))
    assert (y.view(np.uint64) == SPECIAL.view(np.uint64)).all()


@pytest.mark.parametrize("m", BOUNDED)
@pytest.mark.parametrize("bound", [0.3, 5.0])
@pytest.mark.parametrize("name", series())
def test_bounded(m, bound, name):
    x = series()[name]
    y = codec.decompress(codec.compress(x, m, config(m, bound)))
    assert len(y) == len(x) and np.abs(y - x).max() <= bound32(bound) * (1 + 1e-9)


@pytest.mark.parametrize("m", [m for m in M if m not in LOSSLESS])
def test_lengths(m):
    for x in series().values():
        assert len(codec.decompress(codec.compress(x, m, config(m)))) == len(x)


@pytest.mark.parametrize("m", MODELS)
def test_extract_rebuild(m):
    for x in series().values():
        p = codec.compress(x, m, config(m))
        assert codec.rebuild(*codec.extract(p), m) == p


@pytest.mark.parametrize("m", M)
def test_short_series(m):
    assert codec.compress(np.zeros(0), m, {"not": "read"}) == b"" and len(codec.decompress(b"")) == 0
    p = codec.compress(np.array([2.5]), m, None)
    assert p[-1] == 0 and codec.decompress(p).tolist() == [2.5]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(allow_nan=True, allow_infinity=True), min_size=2, max_size=60))
def test_xor_property(xs):
    x = np.array(xs)
    for m in (M.Chimp64, M.Chimp128, M.Elf, M.BitPackedDeltaEncoding):
        assert (codec.decompress(codec.compress(x, m, {})).view(np.uint64) == x.view(np.uint64)).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=2, max_size=60), st.sampled_from(BOUNDED), st.floats(0.01, 1e4))
def test_bound_property(xs, m, bound):
    x = np.array(xs)
    y = codec.decompress(codec.compress(x, m, config(m, bound)))
    assert len(y) == len(x) and np.abs(y - x).max() <= bound32(bound) * (1 + 1e-9) + 1e-9


@pytest.mark.parametrize("m", [M.Chimp64, M.Chimp128, M.Elf, M.MacaqueV, M.SimPiece, M.MixPiece, M.NonLinearApproximation, M.BitPackedBUFF, M.BitPackedDeltaEncoding])
def test_damaged_payloads(m):
    p = codec.compress(series()["decimal"][:20], m, config(m))
    for k in range(0, 8 * (len(p) - 1), 3):
        if m in (M.SimPiece, M.MixPiece) and k // 8 >= len(p) - 9:
            continue  # a changed length is a valid, very long series
        q = bytearray(p)
        q[k // 8] ^= 1 << k % 8
        for data in (bytes(q), p[: k // 8] + p[-1:]):
            try:
                codec.decompress(data)
            except SeriesError:
                pass


def test_golden_points():
    assert codec.model(np.array([1, 2, 1.5, 3, 4, 3.5, 5, 6, 7]), M.LargestTriangleThreeBuckets, {"target_point_count": 4})[0] == [2, 5, 8]
    assert segments.visvalingam(np.array([1, 3, 4, 1.0]), 2.5) == [0, 2, 3]
    assert codec.decompress(codec.compress(np.array([1, 3, 4, 1.0]), M.VisvalingamWhyatt, {"area_under_curve_error": 2.5})).tolist() == [1, 2.5, 4, 1]


ABC = np.array([3, 2, 3.5, 5, 3, 4, 4, 3, 4.5, 3.5, 2.5, 2.5, 3.5, 2.5, 2.5, 2.5, 3, 3, 3, 3, 2.8])


def test_golden_lines():
    ((slope, intercept, end),) = segments.strips(ABC, 5)
    assert abs(slope - 0.036) < 0.1 and abs(intercept - 3.43) < 0.1 and end == 20
    up, down = [], []
    for p in enumerate(ABC.tolist()):
        extend_hull(up, p, True)
        extend_hull(down, p, False)
    assert [p[0] for p in up] == [0, 3, 8, 19, 20] and [p[0] for p in down] == [0, 1, 15, 20]
    assert segments.linear_histogram(np.array([0, 1, 3, 4.0]), 2) == [(0.0, 1.0, 2), (3.0, 4.0, 4)]
    lines = [(0, 0.0), (1, 3.0), (2, 2.0), (3, 5.0), (4, 4.0)]
    up, down = [], []
    for p in lines:
        extend_hull(up, p, True)
        extend_hull(down, p, False)
    assert strip_line(up, down)[:2] == (1.0, 1.0)


def test_golden_histogram():
    x = np.array([0.9, 1.1, 0.7, 1, 0.8, 4.8, 5.2, 4.6, 5, 4.7, 9.8, 10.2, 9.9, 9.7, 10, 10.1])
    v, ends = segments.constant_histogram(x, 3)
    assert ends == [5, 10, 16] and np.allclose(v, [0.9, 4.9, 9.95])


def test_golden_bits():
    w = BitWriter()
    for u in (15, 7, 3, 1):
        put_gamma(w, u)
    assert list(w.bytes()) == [30, 119]
    r = BitReader(w.bytes())
    assert [get_gamma(r) for _ in range(4)] == [15, 7, 3, 1]
    assert [unzigzag(zigzag(x)) for x in (-5, -1, 0, 1, 7)] == [-5, -1, 0, 1, 7]


def test_golden_mean_term():
    y = codec.decompress(codec.compress(np.arange(3.0, 19, 3), M.DiscreteFourierTransform, {"number_of_coefficients": 1}))
    assert np.allclose(y, 10.5)


def test_sizes():
    for m, most in ((M.Chimp64, 2), (M.Chimp128, 9), (M.Elf, 3)):
        assert (len(codec.compress(np.full(801, 7.25), m, {})) - 12) * 8 <= 800 * most


def test_runs_of_nan():
    x = np.array([np.nan, np.nan, 1.0, 1.0])
    assert len(codec.compress(x, M.RunLengthEncoding, {})) == 3 * 16 + 1


@pytest.mark.parametrize("m", [M.SimPiece, M.MixPiece, M.NonLinearApproximation, M.BitPackedQuantization, M.SerfQT, M.SlidingWindow, M.BottomUp])
@pytest.mark.parametrize("bad", [math.nan, math.inf, 1e20])
def test_rejects(m, bad):
    with pytest.raises(SeriesError) as e:
        codec.compress(np.array([343, bad, 520.0]), m, config(m, 0.1))
    assert e.value.code == 2


@pytest.mark.parametrize(("m", "u", "f"), [(M.PoorMansCompressionMidrange, [1], [1, 2]), (M.SimPiece, [0], [1]), (M.SimPiece, [1, 0, 5], [1]), (M.MixPiece, [1, 0, 0, 1, 0], [5]), (M.NonLinearApproximation, [1, 2], [0.5, 1]), (M.NonLinearApproximation, [1, 999, 5], [0, 1, 2]), (M.NonLinearApproximation, [1, 2, 10], [0, 1])])
def test_rebuild_rejects(m, u, f):
    with pytest.raises(SeriesError) as e:
        codec.rebuild(u, f, m)
    assert e.value.code == 4


def test_configurations():
    assert parse_config(M.SwingFilter, '{"abs_error_bound": 0.1}')["abs_error_bound"] == bound32(0.1)
    for m, c in ((M.SwingFilter, {"abs_error_bound": -1}), (M.SwingFilter, {}), (M.Elf, {"x": 1}), (M.PiecewiseConstantHistogram, {"histogram_bins_number": 1}), (M.LargestTriangleThreeBuckets, {"target_point_count": 1}), (M.BitPackedBUFF, {"decimal_precision": 11}), (M.SwingFilter, "{"), (M.PiecewiseConstantHistogram, {"histogram_bins_number": 6.0})):
        with pytest.raises(SeriesError) as e:
            parse_config(m, c)
        assert e.value.code == 3
    with pytest.raises(SeriesError):
        codec.decompress(b"\1\2\x1b")


def test_stabber():
    s = Stabber()
    assert all(s.add(x, 2 * x - 0.5, 2 * x + 0.5) for x in range(10)) and not s.add(10, 30, 31)
    a, b = s.line()
    assert all(2 * x - 0.5 <= a * x + b <= 2 * x + 0.5 for x in range(10))


def test_mean_ties_are_cut_as_in_sql():
    # the mean of six values, 7.89, less the least of them, 2.89, is the bound
    x = [10.57, 7.83, 2.89, 8.54, 8.63, 8.88, 0.91, 0.12]
    ends, start, lo, hi, total = [], 0, x[0], x[0], x[0]
    for i, v in enumerate(x[1:], 1):
        m = (total + v) / (i - start + 1)
        if max(hi, v) - m > 5.0 or m - min(lo, v) > 5.0:
            ends.append(i)
            start, lo, hi, total = i, v, v, v
        else:
            lo, hi, total = min(lo, v), max(hi, v), total + v
    values, got = segments.mean(np.array(x), 5.0)
    assert got == [*ends, len(x)]
    assert values[0] == pytest.approx(sum(x[: got[0]]) / got[0], abs=1e-12)
    assert segments.mean(np.array([0.1] * 3 + [82.61 - 0.3] + [0.0] * 4), 80.0)[0] == [82.61 / 8]


@pytest.mark.parametrize("name", ["walk", "ties"])
def test_longest_line_is_the_stabber(name):
    r = np.random.default_rng(8)
    v = (np.cumsum(r.normal(0, 1, 200)) if name == "walk" else np.round(np.cumsum(r.integers(-1, 2, 200)) / 2, 1)).tolist()
    spans, xs, s = [(y - 1.0, y + 1.0) for y in v] + [None, (0.0, 1.0)], range(300), 0
    while s < len(v):
        fit, i = Stabber(), s
        while spans[i] is not None and fit.add(i - s, *spans[i]):
            i += 1
        assert longest_line(xs, spans, s) == (i, *fit.line())
        s = i
    assert longest_line(xs, spans, 200) == (200, 0.0, 0.0) and longest_line(xs, spans, 201) == (202, 0.0, 0.5)


def test_narrowest_strip_looks_at_all_sides():
    r = np.random.default_rng(9)
    for n in (2, 3, 9, 60):
        upper, lower = [], []
        for p in enumerate(np.round(r.normal(0, 3, n), 1).tolist()):
            extend_hull(upper, p, True)
            extend_hull(lower, p, False)
        sides = [(max(s * (a[1] + (b[1] - a[1]) / (b[0] - a[0]) * (x - a[0]) - y) for x, y in far)) for near, far, s in ((upper, lower, 1), (lower, upper, -1)) for a, b in zip(near, near[1:])]
        assert strip_line(upper, lower)[2] == min(sides) / 2


@pytest.mark.parametrize("v", [1.0, 10.0, 120.0, 0.1, 0.001, 123.456, 0.30000000000000004, 1e15, 1e16, 1.5e-7, 999999.0, 5e-324, 9.999999999999999])
def test_decimal_digits(v):
    _, digits, exponent = Decimal(repr(v)).normalize().as_tuple()
    assert lossless._decimal(-v) == (len(digits), len(digits) + exponent - 1)
    assert lossless._first(v) == Decimal(v).adjusted()
