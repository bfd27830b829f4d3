"""Grouped piece kernels (one or both quantised intercepts) and the five-family non-linear fit.

Their payloads are tapes of unsigned integers and doubles. ``walk_*`` read a tape's structure from
two callables, so the same walk serves the payload, extract and rebuild.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np

from ..methods import corrupted, invalid
from .geometry import longest_line
from .segments import margin
from .values import check_range

Tape = list[tuple[str, float]]


def _cone(v: list[float], s: int, b: float, eb: float) -> tuple[int, float, float]:
    """(end, low, high): how far slopes from (s, b) stay within eb, end past the last point."""
    lo, hi, i = -math.inf, math.inf, s + 1
    while i < len(v):
        x = i - s
        if not (lo * x + b - eb <= v[i] <= hi * x + b + eb) and i > s + 1:
            break
        lo, hi = max(lo, (v[i] - eb - b) / x), min(hi, (v[i] + eb - b) / x)
        i += 1
    return i, lo, hi


def _cones(values: np.ndarray, bound: float, both: bool) -> list[tuple[int, float, float, float]]:
    """(start, intercept, low, high) of greedy cones from intercepts on the grid of the bound."""
    check_range(values)
    if bound <= 0:
        raise invalid("the bound must be positive")
    v, eb, slack, s, out = values.tolist(), margin(bound), bound - margin(bound), 0, []
    while s < len(v):
        down = math.floor(v[s] / bound) * bound + slack
        end, lo, hi = _cone(v, s, down, eb)
        b = down
        if both:
            up = math.ceil(v[s] / bound) * bound - slack
            e2, lo2, hi2 = _cone(v, s, up, eb)
            if e2 > end:
                end, lo, hi, b = e2, lo2, hi2, up
        if end == s + 1:
            lo = hi = 0.0
        out.append((s, b, lo, hi))
        s = end
    return out


def _merged(cones: list[tuple[int, float, float, float]]) -> list[tuple[float, float, list]]:
    """(low, high, cones) of greedy groups of overlapping slope ranges, by low slope."""
    out: list = []
    for c in sorted(cones, key=lambda c: (c[2], c[0])):
        if out and c[2] <= out[-1][1] and c[3] >= out[-1][0]:
            lo, hi, own = out[-1]
            out[-1] = (max(lo, c[2]), min(hi, c[3]), [*own, c])
        else:
            out.append((c[2], c[3], [c]))
    return out


def _steps(starts: list[int]) -> Iterator[int]:
    """Each start less the one before."""
    return (b - a for a, b in zip([0, *starts], starts))


def _by_intercept(groups: dict[float, list[tuple[float, list[int]]]]) -> Tape:
    tape: Tape = []
    for b in sorted(groups):
        tape += [("f", b), ("u", len(groups[b]))]
        for slope, starts in sorted(groups[b]):
            tape += [("f", slope), ("u", len(starts)), *(("u", x) for x in _steps(sorted(starts)))]
    return tape


def sim_piece(values: np.ndarray, bound: float) -> Tape:
    by_b, groups = defaultdict(list), {}
    for c in _cones(values, bound, False):
        by_b[c[1]].append(c)
    for b, cones in by_b.items():
        groups[b] = [((lo + hi) / 2, [c[0] for c in own]) for lo, hi, own in _merged(cones)]
    return [*_by_intercept(groups), ("u", len(values))]


def mix_piece(values: np.ndarray, bound: float) -> Tape:
    by_b, groups, alone = defaultdict(list), defaultdict(list), []
    for c in _cones(values, bound, True):
        by_b[c[1]].append(c)
    for b, cones in by_b.items():
        for lo, hi, own in _merged(cones):
            if len(own) > 1:
                groups[b].append(((lo + hi) / 2, [c[0] for c in own]))
            else:
                alone += own
    crossed, rest = [], []
    for lo, hi, own in _merged(alone):
        if len(own) > 1:
            crossed.append(((lo + hi) / 2, sorted((c[1], c[0]) for c in own)))
        else:
            rest.append(((lo + hi) / 2, own[0][1], own[0][0]))
    tape: Tape = [("u", len(groups)), ("u", len(crossed)), ("u", len(rest)), *_by_intercept(groups)]
    for slope, pairs in sorted(crossed):
        pairs = sorted(pairs, key=lambda p: p[1])
        tape += [("f", slope), ("u", len(pairs))]
        for (b, _), d in zip(pairs, _steps([s for _, s in pairs])):
            tape += [("f", b), ("u", d)]
    rest.sort(key=lambda r: r[2])
    for (slope, b, _), d in zip(rest, _steps([r[2] for r in rest])):
        tape += [("f", slope), ("f", b), ("u", d)]
    return [*tape, ("u", len(values))]


U, G = Callable[[], int], Callable[[], float]


def _walk_intercepts(u: U, f: G, groups: int | None, more: Callable[[], bool], found: list) -> None:
    while more() if groups is None else groups > 0:
        groups = groups if groups is None else groups - 1
        b = f()
        for _ in range(_count(u())):
            slope, at = f(), 0
            for _ in range(_count(u())):
                at += u()
                found.append((at, slope, b))


def _count(n: int) -> int:
    if not 0 < n < 1 << 31:
        raise corrupted("group size")
    return n


def walk_sim(u: U, f: G, more: Callable[[], bool]) -> tuple[list, int]:
    """((start, slope, intercept), length); ``more``: another group stands before the trailing length."""
    found: list = []
    _walk_intercepts(u, f, None, more, found)
    return found, u()


def walk_mix(u: U, f: G, more: Callable[[], bool]) -> tuple[list, int]:
    n1, n2, n3 = u(), u(), u()
    found: list = []
    _walk_intercepts(u, f, n1, more, found)
    for _ in range(n2):
        slope, at = f(), 0
        for _ in range(_count(u())):
            b = f()
            at += u()
            found.append((at, slope, b))
    at = 0
    for _ in range(n3):
        slope, b = f(), f()
        at += u()
        found.append((at, slope, b))
    return found, u()


def piece_values(found: list, n: int) -> np.ndarray:
    found = sorted(found)
    starts = [x[0] for x in found]
    if not found or n >= 1 << 31 or starts[0] != 0 or starts[-1] >= n or len(set(starts)) < len(starts):
        raise corrupted("segment starts")
    sizes = np.diff([*starts, n])
    slope, b = np.repeat([x[1] for x in found], sizes), np.repeat([x[2] for x in found], sizes)
    return slope * (np.arange(n) - np.repeat(starts, sizes)) + b


#: Codes of the function families; x counts from 1 within a segment.
FAMILIES = {1: "linear", 2: "quadratic", 3: "exponential", 4: "power", 5: "sqrt"}
_ORDER = (1, 2, 3, 4, 5)


def _x_of(code: int, x: float) -> float:
    return x if code in (1, 3) else x * x if code == 2 else math.log(x) if code == 4 else math.sqrt(x)


def _spans(v: list[float], eb: float) -> dict[int, list[tuple[float, float] | None]]:
    """By family, where a line must pass each value; logs make exponential and power lines."""
    plain = [(y - eb, y + eb) for y in v]
    logs = [(math.log(lo), math.log(hi)) if lo > 0 else None for lo, hi in plain]
    return {1: plain, 2: plain, 3: logs, 4: logs, 5: plain}


def family_values(code: int, slope: float, intercept: float, n: int) -> np.ndarray:
    x = np.arange(1, n + 1, dtype=np.float64)
    if code in (3, 4):
        return np.exp(intercept + slope * (x if code == 3 else np.log(x)))
    return slope * (x if code == 1 else x * x if code == 2 else np.sqrt(x)) + intercept


def nonlinear(values: np.ndarray, bound: float) -> tuple[float, list[tuple[int, float, float, int]]]:
    """(shift, (family, slope, intercept, end)): fewest segments by a shortest path over the positions."""
    check_range(values)
    eb = margin(bound)
    if eb <= 0:
        raise invalid("the bound is too small")
    shift = max(0.0, -float(values.min())) + 1.0 + eb
    v, n = (values + shift).tolist(), len(values)
    dist, how = [0] + [math.inf] * n, [None] * (n + 1)
    spans, xs = _spans(v, eb), {code: [_x_of(code, x) for x in range(1, n + 1)] for code in _ORDER}
    current: dict[int, tuple[int, int, float, float]] = {}
    for p in range(n):
        for code in _ORDER:
            s, end, a, b = current.get(code, (p, p, 0.0, 0.0))
            if end <= p:
                e2, a, b = longest_line(xs[code], spans[code], p)
                s, end = p, e2
                current[code] = (s, end, a, b)
            elif dist[s] + 2 < dist[p]:
                dist[p], how[p] = dist[s] + 2, (s, code, a, b)
        for code, (s, end, a, b) in current.items():
            if end > p and dist[s] + 2 < dist[end]:
                dist[end], how[end] = dist[s] + 2, (s, code, a, b)
        if dist[p + 1] == math.inf:
            dist[p + 1], how[p + 1] = dist[p] + 2, (p, 1, 0.0, v[p])
    out, at = [], n
    while at:
        s, code, a, b = how[at]
        out.append((code, a, b, at))
        at = s
    out.reverse()
    # rounding may carry a point past the bound; such a segment is halved until it does not
    done, s = [], 0
    todo = out[::-1]
    while todo:
        code, a, b, e = todo.pop()
        if e - s == 1:
            done.append((1, 0.0, v[s], e))
        elif np.abs(family_values(code, a, b, e - s) - shift - values[s:e]).max() <= bound:
            done.append((code, a, b, e))
        else:
            mid = s + (e - s + 1) // 2
            todo.append((1, *longest_line(xs[1], spans[1][:e], mid)[1:], e) if e - mid > 1 else (1, 0.0, v[mid], e))
            todo.append((1, *longest_line(xs[1], spans[1][:mid], s)[1:], mid) if mid - s > 1 else (1, 0.0, v[s], mid))
            continue
        s = e
    return shift, done
