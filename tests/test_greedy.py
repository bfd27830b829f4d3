"""Segments of long series in parallel against the kernel over the whole series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.kernels import segments
from loomline.plans import greedy


def series(kind, n, r):
    if kind == "walk":
        return np.cumsum(r.normal(0, 1, n))
    if kind == "flat":  # segments over many blocks
        return np.repeat(r.normal(0, 30, -(-n // 150)), 150)[:n]
    if kind == "ramp":  # each open end is a class of its own
        return np.arange(n) * 0.07
    if kind == "one":
        return np.full(n, 3.0)
    return r.normal(0, 50, n)


@pytest.mark.parametrize("bound,block", [(5.0, 16), (1.0, 7), (0.0, 5)])
def test_segments_are_those_of_the_kernel(spark, bound, block):
    r = np.random.default_rng(3)
    data = {f"{kind}{n}": series(kind, n, r) for kind in ("walk", "flat", "ramp", "one", "noise") for n in (1, 15, 16, 400)}
    df = spark.createDataFrame([(k, i, float(x)) for k, v in data.items() for i, x in enumerate(v)], "id string, t int, value double").repartition(5)
    found = greedy.midrange_segments(greedy.numbered(df, ["id"], ["t"]), ["id"], bound, block)
    got = {}
    for x in found.collect():
        got.setdefault(x.id, []).append((x.start_idx, x.end_idx, x.lo, x.hi))
    for k, v in data.items():
        _, ends = segments.midrange(v, bound)
        want = [(a, b, v[a:b].min(), v[a:b].max()) for a, b in zip([0, *ends], ends)]
        assert sorted(got[k]) == want, k


def test_one_key_is_many_tasks(spark):
    df = spark.range(3000).select(F.lit("x").alias("id"), F.col("id").alias("t"), F.rand(1).alias("value"))
    points = greedy.numbered(df, ["id"], ["t"])
    assert "Window" in points._jdf.queryExecution().executedPlan().toString()  # over the parts, not the points
    assert points.agg(F.sum("idx"), F.max("idx")).first()[:] == (2999 * 3000 // 2, 2999)
    assert greedy.midrange_segments(points.limit(0), ["id"], 0.2, 64).count() == 0


def test_null_keys_raise(spark):
    df = spark.createDataFrame([("a", 1, 1.0), (None, 1, 2.0)], "id string, t int, value double")
    with pytest.raises(Exception, match="null in key id"):
        greedy.numbered(df, ["id"], ["t"]).collect()


def test_next_starts():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 8, 77):
        v = r.normal(0, 1, n)
        end, lo, hi = greedy.next_starts(v, 1.5)
        for i in range(n):
            j = next((j for j in range(i + 1, n + 1) if j == n or np.ptp(v[i : j + 1]) > 1.5))
            assert (end[i], lo[i], hi[i]) == (j, v[i:j].min(), v[i:j].max())
