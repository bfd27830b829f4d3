"""Methods, configurations and errors of the series operators."""

from __future__ import annotations

import json
from enum import IntEnum

import numpy as np

#: Values of larger magnitude are refused by the methods that quantise or fit.
MAX_ABS_VALUE = 1e15


class Method(IntEnum):
    """The ordinal is the last byte of each payload."""

    Uncompressed = 0
    PoorMansCompressionMidrange = 1
    PoorMansCompressionMean = 2
    SwingFilter = 3
    SwingFilterDisconnected = 4
    SlideFilter = 5
    SimPiece = 6
    PiecewiseConstantHistogram = 7
    PiecewiseLinearHistogram = 8
    ABCLinearApproximation = 9
    VisvalingamWhyatt = 10
    SlidingWindow = 11
    BottomUp = 12
    MixPiece = 13
    BitPackedQuantization = 14
    RunLengthEncoding = 15
    NonLinearApproximation = 16
    SerfQT = 17
    BitPackedBUFF = 18
    Chimp64 = 19
    Chimp128 = 20
    BitPackedDeltaEncoding = 21
    DiscreteFourierTransform = 22
    MacaqueS = 23
    MacaqueV = 24
    LargestTriangleThreeBuckets = 25
    Elf = 26


def max_method_index() -> int:
    return int(max(Method))


#: Error names and their codes.
ERROR_CODES = {"UnknownMethod": 1, "UnsupportedInput": 2, "InvalidConfiguration": 3, "CorruptedCompressedData": 4, "ItemNotFound": 5, "EmptyConvexHull": 6, "EmptyQueue": 7, "ByteStreamError": 8, "UnsupportedMethod": 9, "OutOfMemory": 10, "WriteFailed": 11}


class SeriesError(ValueError):
    def __init__(self, name: str, detail: str = ""):
        super().__init__(f"{name}: {detail}" if detail else name)
        self.name, self.code = name, ERROR_CODES[name]


def unsupported(detail: str = "") -> SeriesError:
    return SeriesError("UnsupportedInput", detail)


def corrupted(detail: str = "") -> SeriesError:
    return SeriesError("CorruptedCompressedData", detail)


def invalid(detail: str = "") -> SeriesError:
    return SeriesError("InvalidConfiguration", detail)


M = Method
#: The configuration fields of each method: name and kind (bound: float32 >= 0; count: integer >= 1; text).
_ABSOLUTE = {"abs_error_bound": "bound"}
FIELDS: dict[Method, dict[str, str]] = {
    **dict.fromkeys([M.PoorMansCompressionMidrange, M.PoorMansCompressionMean, M.SwingFilter, M.SwingFilterDisconnected, M.SlideFilter, M.SimPiece, M.MixPiece, M.ABCLinearApproximation, M.NonLinearApproximation, M.SerfQT, M.BitPackedQuantization, M.MacaqueS, M.MacaqueV], _ABSOLUTE),
    **dict.fromkeys([M.PiecewiseConstantHistogram, M.PiecewiseLinearHistogram], {"histogram_bins_number": "count"}),
    M.LargestTriangleThreeBuckets: {"target_point_count": "count"},
    **dict.fromkeys([M.SlidingWindow, M.BottomUp], {"aggregate_error_type": "text", "aggregate_error_bound": "bound"}),
    M.VisvalingamWhyatt: {"area_under_curve_error": "bound"},
    M.DiscreteFourierTransform: {"number_of_coefficients": "count"},
    M.BitPackedBUFF: {"decimal_precision": "precision"},
    **dict.fromkeys([M.RunLengthEncoding, M.Chimp64, M.Chimp128, M.BitPackedDeltaEncoding, M.Elf], {}),
}
#: Methods whose payload is a bit stream: extract and rebuild do not know them.
BIT_STREAMS = frozenset({M.BitPackedQuantization, M.RunLengthEncoding, M.SerfQT, M.BitPackedBUFF, M.Chimp64, M.Chimp128, M.BitPackedDeltaEncoding, M.MacaqueS, M.MacaqueV, M.Elf, M.Uncompressed})


def method_of(method: Method | int | str) -> Method:
    try:
        return Method[method] if isinstance(method, str) else Method(method)
    except (KeyError, ValueError):
        raise SeriesError("UnknownMethod", str(method)) from None


def bound32(x: float) -> float:
    """An error bound as it is stored: in single precision."""
    return float(np.float32(x))


def parse_config(method: Method, config: dict | str | None) -> dict:
    """Checked configuration with bounds in single precision; the raw method ignores its configuration."""
    if method == Method.Uncompressed:
        return {}
    return parse_fields(config, FIELDS[method])


def parse_relative_bound(config: dict | str | None) -> dict:
    """Checked configuration of a relative error bound, which no method takes."""
    return parse_fields(config, {"rel_error_bound": "bound"})


def parse_fields(config: dict | str | None, fields: dict[str, str]) -> dict:
    """Checked configuration of exactly ``fields``."""
    if isinstance(config, str):
        try:
            pairs = json.loads(config, object_pairs_hook=list)
        except ValueError:
            raise invalid("not JSON") from None
        if not isinstance(pairs, list) or not all(isinstance(p, tuple) for p in pairs) or len({k for k, _ in pairs}) != len(pairs):
            raise invalid("an object with distinct names is needed")
        config = dict(pairs)
    config = dict(config or {})
    if set(config) != set(fields):
        raise invalid(f"needed are {sorted(fields)}")
    out = {}
    for name, kind in fields.items():
        x = config[name]
        if kind == "text":
            if not isinstance(x, str):
                raise invalid(name)
        elif kind == "bound":
            if isinstance(x, bool) or not isinstance(x, (int, float)) or not 0 <= x < float("inf"):
                raise invalid(name)
            x = bound32(x)
        elif isinstance(x, bool) or not isinstance(x, int) or not 1 <= x < (64 if kind == "precision" else 1 << 32):
            raise invalid(name)
        out[name] = x
    if out.get("histogram_bins_number", 2) < 2 or out.get("target_point_count", 2) < 2 or out.get("decimal_precision", 1) > 10:
        raise invalid("too small or too large")
    return out


def default_config(method: Method, rng: np.random.Generator) -> dict:
    """A valid configuration of a method, drawn from ``rng``: bounds below 10, counts of 2 to 10."""
    draw = {"bound": lambda: float(np.float32(rng.uniform(0, 10))), "count": lambda: int(rng.integers(2, 11)), "precision": lambda: int(rng.integers(1, 11)), "text": lambda: "rmse"}
    return {name: draw[kind]() for name, kind in FIELDS.get(method, {}).items()}
