"""Overlap and as-of joins against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.methods import Method
from loomline.operators import asof, series
from loomline.plans import intervals, native

M = Method


@pytest.mark.parametrize("block", [7, 4096])
def test_overlap_is_the_join_of_points(spark, block):
    r = np.random.default_rng(8)
    data = [(k, i, float(v)) for k, n in (("a", 80), ("b", 9), ("c", 2)) for i, v in enumerate(np.cumsum(r.normal(0, 1, n)))]
    packed = series.pack(spark.createDataFrame(data, "id string, idx long, value double"), ["id"])
    tables, decoded = [], []
    for m, config in ((M.SwingFilter, {"abs_error_bound": 1.5}), (M.PoorMansCompressionMidrange, {"abs_error_bound": 2.0})):
        payload = series.compress(packed, m, config)
        tables.append(intervals.disjoint(native.segment_table(series.extract(payload), ["id"], m), ["id"]))
        decoded.append({(x.id, x.idx): x.value for x in series.unpack(series.decompress(payload), ["id"]).collect()})
    combined = intervals.combine(intervals.overlap(*tables, ["id"], block), ["id"])
    points = {(x.id, x.idx): (x.total, x.difference, x.product) for x in intervals.combined_points(combined, ["id"]).collect()}
    assert points.keys() == decoded[0].keys()
    for k, got in points.items():
        a, b = decoded[0][k], decoded[1][k]
        assert np.allclose(got, (a + b, a - b, a * b))
    for x in intervals.combined_sums(combined, ["id"]).collect():
        own = [v for k, v in points.items() if k[0] == x.id]
        assert x.n == len(own) and np.allclose((x.total, x.difference, x.product), np.sum(own, axis=0))


def test_overlap_of_gaps_and_nothing(spark):
    schema = "id string, seg long, start_idx long, end_idx long, c0 double, c1 double"
    left = spark.createDataFrame([("a", 0, 0, 4, 0.0, 3.0), ("a", 1, 10, 12, 5.0, 6.0), ("b", 0, 0, 3, 1.0, 1.0)], schema)
    right = spark.createDataFrame([("a", 0, 2, 11, 1.0, 10.0), ("c", 0, 0, 3, 1.0, 1.0)], schema)
    got = sorted(tuple(x) for x in intervals.overlap(left, right, ["id"], 100).collect())
    assert got == [("a", 2, 4, 2.0, 3.0, 1.0, 2.125), ("a", 10, 11, 5.0, 5.0, 10.0, 10.0)]
    assert intervals.overlap(left, right.limit(0), ["id"]).count() == 0


@pytest.mark.parametrize("width", [None, 5, 1000])
@pytest.mark.parametrize("tolerance", [None, 4])
def test_asof_join_is_brute_force(spark, width, tolerance):
    r = random.Random(9)
    left = [(r.choice(["a", "b", None]), r.choice([None, *range(-20, 60)]), i) for i in range(120)]
    right = [(r.choice(["a", "c", None]), r.choice([None, *range(-10, 60, 3)]), r.choice([1.5, None, 2.5]), i) for i in range(60)]
    a = spark.createDataFrame(left, "id string, at long, side long").withColumn("t", F.lit("own"))
    b = spark.createDataFrame(right, "id string, at long, v double, n long")
    got = asof.asof_join(a, b, ["id"], "at", {"v": "v", "n": "found"}, tolerance, width, time="seen")
    assert got.columns == ["id", "at", "side", "t", "v", "found", "seen"]
    rows = {x.side: (x.v, x.found, x.seen) for x in got.collect()}
    for k, t, i in left:
        fits = [x for x in right if x[0] == k and t is not None and x[1] is not None and x[1] <= t]
        best = max(fits, key=lambda x: (x[1], x[2] is not None, x[2] or 0, x[3]), default=None)
        want = (None, None, None) if best is None or (tolerance is not None and t - best[1] > tolerance) else (best[2], best[3], best[1])
        assert rows[i] == want
    assert asof.asof_join(a.limit(0), b, ["id"], "at", {"v": "v"}).count() == 0 and asof.asof_join(a, b.limit(0), ["id"], "at", {"v": "v"}).where("v IS NOT NULL").count() == 0


@pytest.mark.parametrize("width", [None, 6])
def test_aligned_series(spark, width):
    r = random.Random(10)
    data = {n: [("k", r.randrange(60), float(i)) for i in range(20)] + [("k", None, 1.0), ("k", 3, None)] for n in ("x", "y", "z")}
    frames = {n: spark.createDataFrame(rows, "id string, at long, value double") for n, rows in data.items()}
    got = {x.at: (x.x, x.y, x.z) for x in asof.align_series(frames, ["id"], "at", "value", 10, width).collect()}
    known = {n: {t: max(v for _, u, v in rows if u == t and v is not None) for _, t, v in rows if t is not None and v is not None} for n, rows in data.items()}
    assert got.keys() == set().union(*known.values())
    for t, row in got.items():
        for n, v in zip("xyz", row):
            seen = max((u for u in known[n] if u <= t), default=None)
            assert v == (known[n][seen] if seen is not None and t - seen <= 10 else None)
