"""Piece tables against the decoded points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.methods import Method, SeriesError
from loomline.operators import series
from loomline.plans import piecewise

M = Method


@pytest.mark.parametrize("m,config", [(M.SimPiece, {"abs_error_bound": 1.0}), (M.MixPiece, {"abs_error_bound": 1.0}), (M.NonLinearApproximation, {"abs_error_bound": 0.5}), (M.ABCLinearApproximation, {"abs_error_bound": 1.0})])
def test_pieces_are_the_decoded_points(spark, m, config):
    r = np.random.default_rng(12)
    shapes = {"walk": np.cumsum(r.normal(0, 1, 150)), "exp": np.exp(np.arange(120) / 25), "power": np.arange(1, 130) ** 1.7, "root": 9 * np.sqrt(np.arange(1, 200)), "square": 0.05 * np.arange(90) ** 2.0, "two": np.array([1.0, 5.0]), "flat": np.full(70, 2.0)}
    packed = series.pack(spark.createDataFrame([(k, i, float(v)) for k, vs in shapes.items() for i, v in enumerate(vs)], "id string, idx long, value double"), ["id"])
    payload = series.compress(packed, m, config)
    points = {(x.id, x.idx): x.value for x in series.unpack(series.decompress(payload), ["id"]).collect()}
    pieces = piecewise.piece_table(series.extract(payload), ["id"], m).cache()
    got = {(x.id, x.idx): x.value for x in piecewise.decode(pieces, ["id"]).collect()}
    assert got.keys() == points.keys() and np.allclose([got[k] for k in points], list(points.values()), rtol=1e-9, atol=1e-8)
    part = piecewise.decode(pieces, ["id"], 20, 40).collect()
    assert len(part) == sum(20 <= i < 40 for _, i in points)
    for x in piecewise.aggregate(pieces, ["id"]).collect():
        own = [v for (k, _), v in points.items() if k == x.id]
        assert x.n == len(own) and np.allclose((x.total, x.least, x.most), (sum(own), min(own), max(own)), rtol=1e-9, atol=1e-7)
    if m is M.NonLinearApproximation:
        assert {x.family for x in pieces.select("family").distinct().collect()} >= {1, 3}


def test_sums_of_each_family(spark):
    rows = [(f, a, b, x, n) for f in range(1, 6) for a, b in ((0.03, 0.2), (-0.02, 1.0), (0.0, 0.5), (1e-15, 1.0), (-1.0, 0.3)) for x in (1, 7) for n in (1, 5, 24, 25, 300)]
    df = spark.createDataFrame([(i, 0, 10, 10 + n, f, a, b, x, 0.25) for i, (f, a, b, x, n) in enumerate(rows)], "id int, seg long, start_idx long, end_idx long, family int, slope double, intercept double, first_x long, shift double")
    want = {x.id: x.v for x in piecewise.decode(df, ["id"]).groupBy("id").agg(F.sum("value").alias("v")).collect()}
    for x in piecewise.aggregate(df, ["id"]).collect():
        assert abs(x.total - want[x.id]) <= 1e-10 * max(1, abs(want[x.id])), rows[x.id]


def test_other_methods_are_refused(spark):
    with pytest.raises(SeriesError):
        piecewise.piece_table(spark.range(1), ["id"], M.SwingFilter)
