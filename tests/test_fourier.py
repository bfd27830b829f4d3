"""Transforms over partitions and queries on kept terms against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.methods import Method
from loomline.operators import series
from loomline.plans import fourier


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(14)
    return {f"s{n}": r.normal(3, 10, n) for n in (1, 2, 3, 7, 36, 97, 100, 128, 251)}


@pytest.fixture(scope="module")
def points(spark, data):
    return spark.createDataFrame([(k, i, float(v)) for k, vs in data.items() for i, v in enumerate(vs)], "id string, idx long, value double").repartition(4).cache()


@pytest.mark.parametrize("most,small", [(5, 0), (1 << 20, 0), (12, 50), (1 << 20, 4096)])
def test_transform_is_numpy(spark, data, points, most, small):
    rows = points.select("id", "idx", F.col("value").alias("re"), (F.col("value") / 3 + F.col("idx") % 3).alias("im"))
    got = {}
    for x in fourier.transform(rows, ["id"], most, small).collect():
        got.setdefault(x.id, {})[x.k] = complex(x.re, x.im)
    for k, v in data.items():
        want = np.fft.fft(v + 1j * (v / 3 + np.arange(len(v)) % 3))
        assert sorted(got[k]) == list(range(len(v))) and np.allclose([got[k][i] for i in range(len(v))], want, atol=1e-8)


def test_all_terms_give_the_points(data, points):
    got = {(x.id, x.idx): x.value for x in fourier.values(fourier.terms(points, ["id"], 5, 2), ["id"]).collect()}
    assert len(got) == sum(map(len, data.values())) and all(abs(got[k, i] - v) < 1e-8 for k, vs in data.items() for i, v in enumerate(vs))


def test_queries_on_kept_terms(spark, data, points):
    some = points.where("id IN ('s36', 's97', 's128', 's251')")
    payload = series.compress(series.pack(some, ["id"]), Method.DiscreteFourierTransform, {"number_of_coefficients": 9})
    decoded = {}
    for x in series.unpack(series.decompress(payload), ["id"]).orderBy("idx").collect():
        decoded.setdefault(x.id, []).append(x.value)
    table = fourier.term_table(series.extract(payload), ["id"])
    assert {(x.id, x.k) for x in table.collect()} == {(x.id, x.k) for x in fourier.strongest(fourier.terms(some, ["id"]), ["id"], 9).collect()}
    part = {(x.id, x.idx): x.value for x in fourier.values(table, ["id"], 20, 50).collect()}
    assert len(part) == sum(len(v[20:50]) for v in decoded.values()) and all(abs(decoded[k][i] - v) < 1e-9 for (k, i), v in part.items())
    for x in fourier.range_sums(table, ["id"], 20, 120).collect():
        assert x["count"] == len(decoded[x.id][20:120]) and abs(x.total - sum(decoded[x.id][20:120])) < 1e-8
    energy = some.groupBy("id").agg(F.sum(F.col("value") * F.col("value")).alias("energy"))
    for x in fourier.lost(table, ["id"], energy).collect():
        assert abs(x.rmse - np.sqrt(np.mean((np.array(decoded[x.id]) - data[x.id]) ** 2))) < 1e-9
    assert fourier.terms(points.limit(0), ["id"]).count() == 0
