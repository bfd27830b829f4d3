"""Plane geometry of the fitting kernels: hulls, stabbing lines and the narrowest strip."""

from __future__ import annotations

import math
from collections.abc import Sequence


def extend_hull(chain: list[tuple], p: tuple, upper: bool) -> None:
    """Add a point to the right of an upper or lower hull."""
    px, py = p
    while len(chain) > 1:
        (ax, ay), (bx, by) = chain[-2], chain[-1]
        turn = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
        if not (turn >= 0 if upper else turn <= 0):
            break
        chain.pop()
    chain.append(p)


def strip_line(upper: list[tuple], lower: list[tuple]) -> tuple[float, float, float]:
    """(slope, intercept, largest error) of the line with the least vertical error to the points of two hulls."""
    if len(upper) == 1:
        return 0.0, upper[0][1], 0.0
    best, found = math.inf, (0.0, 0.0)
    for near, far, sign in ((upper, lower, 1), (lower, upper, -1)):
        ax, ay = near[0]
        worst = far[0]
        for bx, by in near[1:]:
            slope = (by - ay) / (bx - ax)
            # a side as wide as the best one is given up; the point that was furthest from the side before comes first
            x, y = worst
            width = sign * (ay + slope * (x - ax) - y)
            if width < best:
                for p in far:
                    x, y = p
                    d = sign * (ay + slope * (x - ax) - y)
                    if d > width:
                        width, worst = d, p
                        if not d < best:
                            break
                if width < best:
                    best, found = width, (slope, ay - slope * ax - sign * width / 2)
            ax, ay = bx, by
    return *found, best / 2


class Stabber:
    """Lines that meet every vertical interval [lo, hi] at x, kept as the flattest and the steepest one."""

    def __init__(self):
        self.n, self.lows, self.highs = 0, [], []

    def add(self, x: float, lo: float, hi: float) -> bool:
        """Take one more interval, further right; False (and no change) if no line meets them all."""
        if self.n >= 2:
            s, px, py = self.flat_line
            flat = py + s * (x - px)
            s, px, py = self.steep_line
            steep = py + s * (x - px)
            if flat > hi or steep < lo:
                return False
        if self.n == 0:
            self.x0 = x
        elif self.n == 1:
            (_, lo0), (_, hi0) = self.lows[0], self.highs[0]
            self.steep_line = ((hi - lo0) / (x - self.x0), self.x0, lo0)
            self.flat_line = ((lo - hi0) / (x - self.x0), self.x0, hi0)
        else:
            if hi < steep:
                s, p = min([((hi - q[1]) / (x - q[0]), q) for q in self.lows])
                self.steep_line = (s, *p)
            if lo > flat:
                s, p = max([((lo - q[1]) / (x - q[0]), q) for q in self.highs])
                self.flat_line = (s, *p)
        extend_hull(self.lows, (x, lo), True)
        extend_hull(self.highs, (x, hi), False)
        self.n += 1
        return True

    def line(self) -> tuple[float, float]:
        """(slope, intercept) through the crossing of the two lines, half way between their slopes."""
        if self.n == 1:
            return 0.0, (self.lows[0][1] + self.highs[0][1]) / 2
        (a, ax, ay), (b, bx, by) = self.steep_line, self.flat_line
        slope = (a + b) / 2
        x = self.x0 if a == b else ((by - b * bx) - (ay - a * ax)) / (a - b)
        y = (ay + a * (x - ax) + by + b * (x - bx)) / 2
        return slope, y - slope * x


def longest_line(xs: Sequence[float], spans: list[tuple[float, float] | None], at: int) -> tuple[int, float, float]:
    """(end, slope, intercept) of the longest run of spans from ``at`` that a line meets, the k-th of them at ``xs[k]``: as a ``Stabber`` finds it, without a call a point."""
    n = len(spans)
    if at >= n or spans[at] is None:
        return at, 0.0, 0.0
    x0 = xs[0]
    lo0, hi0 = spans[at]
    if at + 1 == n or spans[at + 1] is None:
        return at + 1, 0.0, (lo0 + hi0) / 2
    x = xs[1]
    lo, hi = spans[at + 1]
    # the steepest line through (sx, sy) and the flattest one through (fx, fy)
    steep, sx, sy = (hi - lo0) / (x - x0), x0, lo0
    flat, fx, fy = (lo - hi0) / (x - x0), x0, hi0
    lows, highs = [(x0, lo0), (x, lo)], [(x0, hi0), (x, hi)]
    i = at + 2
    while i < n and spans[i] is not None:
        lo, hi = spans[i]
        x = xs[i - at]
        least, most = fy + flat * (x - fx), sy + steep * (x - sx)
        if least > hi or most < lo:
            break
        if hi < most:
            steep = math.inf
            for qx, qy in lows:
                slope = (hi - qy) / (x - qx)
                if slope < steep:
                    steep, sx, sy = slope, qx, qy
        if lo > least:
            flat = -math.inf
            for qx, qy in highs:
                slope = (lo - qy) / (x - qx)
                if slope >= flat:
                    flat, fx, fy = slope, qx, qy
        while len(lows) > 1:
            ax, ay = lows[-2]
            bx, by = lows[-1]
            if not (bx - ax) * (lo - ay) - (by - ay) * (x - ax) >= 0:
                break
            lows.pop()
        lows.append((x, lo))
        while len(highs) > 1:
            ax, ay = highs[-2]
            bx, by = highs[-1]
            if not (bx - ax) * (hi - ay) - (by - ay) * (x - ax) <= 0:
                break
            highs.pop()
        highs.append((x, hi))
        i += 1
    slope = (steep + flat) / 2
    x = x0 if steep == flat else ((fy - flat * fx) - (sy - steep * sx)) / (steep - flat)
    y = (sy + steep * (x - sx) + fy + flat * (x - fx)) / 2
    return i, slope, y - slope * x


def triangle_area(x1: float, y1: float, x2: float, y2: float, x3: float, y3: float) -> float:
    return abs(x1 * (y2 - y3) + x2 * (y3 - y1) + x3 * (y1 - y2)) / 2
