"""Sizes from expressions against the encoded payloads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.kernels import codec
from loomline.kernels.bits import bits_of
from loomline.methods import Method
from loomline.plans import sizes

M = Method


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(21)
    out = {f"d{p}": np.round(np.cumsum(r.normal(0, 3, 300)), p) for p in range(5)}
    out |= {"random": r.normal(0, 1e3, 200), "positive": np.round(r.exponential(60, 400), 2), "levels": np.round(r.choice([1.5, 2.25, 100.0, 1e-3, 300], 400), 3), "same": np.full(50, 0.1), "one": np.array([3.5]), "two": np.array([1.0, 1.0]), "signs": np.array([0.0, -0.0, 1.0, -1.0, -0.0, 5e-310, -3.25, 1e300, 1e-5, 0.001])}
    return {k: v.astype(float) for k, v in out.items()}


def test_sizes_are_those_of_payloads(spark, data):
    points = spark.createDataFrame([(k, i, float(v)) for k, vs in data.items() for i, v in enumerate(vs)], "id string, idx long, value double").repartition(4)
    got = {(x.id, x.method): (x.n, x.bytes) for x in sizes.lossless_sizes(points, ["id"]).collect()}
    for k, v in data.items():
        for m in (M.Uncompressed, M.RunLengthEncoding, M.Chimp64, M.Chimp128, M.BitPackedDeltaEncoding, M.Elf):
            assert got[k, int(m)] == (len(v), len(codec.compress(v, m, {}))), (k, m)


def test_bits(spark):
    values = [0.0, -0.0, 1.0, -2.5, 5e-324, -2.2e-308, 1.7e308, float("inf"), float("-inf"), 0.1, 3.3e-5, 2.0**52 + 1]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", sizes.double_bits(F.col("v")).alias("b"))
    for x in df.collect():
        assert x.b & (1 << 64) - 1 == bits_of(x.v), x.v


def test_each_method_is_a_stage(spark, data):
    """The rows of a task are those of one method: what is put together has been shuffled, so its sorts lie in other tasks."""
    points = spark.createDataFrame([("a", 0, 1.5), ("a", 1, 2.5), ("b", 0, 1.5)], "id string, idx long, value double")
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = sizes.lossless_sizes(points, ["id"])._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)

    def below(p):
        return [p.children().apply(i) for i in range(p.children().size())]

    def find(p):
        return [p] if p.nodeName() == "Union" else [u for c in below(p) for u in find(c)]

    (union,) = find(plan)
    assert len(below(union)) == 6
    for child in below(union):
        while child.nodeName().startswith(("WholeStageCodegen", "InputAdapter", "Project")):
            (child,) = below(child)
        assert child.nodeName() == "Exchange"
