"""Configurations and the scalar comparison."""

import numpy as np
import pytest

from loomline.kernels import codec
from loomline.methods import Method, SeriesError, bound32, default_config, parse_config, parse_relative_bound
from loomline.operators import series


def test_relative_bound():
    assert parse_relative_bound('{"rel_error_bound": 0.1}') == {"rel_error_bound": bound32(0.1)}
    assert parse_relative_bound({"rel_error_bound": 0}) == {"rel_error_bound": 0.0}


@pytest.mark.parametrize("config", ['{"abs_error_bound": 0.1}', '{"rel_error_bound": "x"}', '{"rel_error_bound": -0.1}', '{"rel_error_bound": NaN}', '{"rel_error_bound": 1, "rel_error_bound": 1}', "{}", "[1]", "", None])
def test_relative_bound_refused(config):
    with pytest.raises(SeriesError) as e:
        parse_relative_bound(config)
    assert e.value.name == "InvalidConfiguration"


@pytest.mark.parametrize("method", Method)
def test_default_configurations(method):
    rng, x = np.random.default_rng(int(method)), np.round(np.sin(np.arange(60.0)) * 40, 2)
    for _ in range(5):
        config = default_config(method, rng)
        parse_config(method, config)
        assert len(codec.decompress(codec.compress(x, method, config))) == len(x)


def test_nearly_equal(spark):
    nan, inf = float("nan"), float("inf")
    cases = [(1.0, 1.0, True), (0.0, 1e-12, True), (0.0, 2e-12, False), (1e6, 1e6 * (1 + 5e-16), True), (1e6, 1e6 + 1e-8, False), (inf, inf, True), (inf, -inf, False), (inf, 1.0, False), (nan, nan, False), (nan, 1.0, False), (1.0, nan, False), (None, 1.0, None), (None, None, None)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a double, b double")
    got = rows.select("i", series.nearly_equal(rows.a, rows.b).alias("near")).orderBy("i").collect()
    assert [r.near for r in got] == [c[2] for c in cases]
