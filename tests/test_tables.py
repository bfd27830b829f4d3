"""Zone maps, the data source and the SQL table functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.functions import udfs
from loomline.methods import Method
from loomline.operators import series
from loomline.sources import format as points_format
from loomline.sources import tables

M = Method


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(15)
    rows = [(k, i, float(v)) for k in range(12) for i, v in enumerate(np.cumsum(r.normal(0, 1, 40 + k)) + 10 * k)]
    return spark.createDataFrame(rows, "id long, idx long, value double").cache()


def as_set(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("m,config", [(M.Elf, {}), (M.SwingFilter, {"abs_error_bound": 0.5}), (M.PoorMansCompressionMean, {"abs_error_bound": 0.5}), (M.SimPiece, {"abs_error_bound": 0.5}), (M.VisvalingamWhyatt, {"area_under_curve_error": 1.0})])
def test_zones_prune(spark, points, m, config, tmp_path):
    packed = series.pack(points, ["id"], 9)
    table = tables.zoned(packed, ["id", series.CHUNK], m, config)
    table.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    decoded = series.unpack(series.decompress(series.compress(packed, m, config)), ["id"], 9).cache()
    zones = decoded.groupBy("id", F.expr("idx div 9").alias("chunk")).agg(F.min("value").alias("a"), F.max("value").alias("b"))
    for x in table.join(zones, ["id", "chunk"]).collect():
        assert np.isclose(x.least, x.a) and np.isclose(x.most, x.b)
    want = decoded.where("value BETWEEN 52 AND 57")
    found = tables.values_between(table, ["id"], 52.0, 57.0, 9)
    assert as_set(found) == as_set(want)
    assert 0 < tables.may_hold(table, 52.0, 57.0).count() < table.count() / 2
    plan = tables.may_hold(table, 52.0, 57.0)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(most,52.0)" in plan and "LessThanOrEqual(least,57.0)" in plan


def test_zones_of_nan_and_short_series(spark):
    packed = spark.createDataFrame([(1, [1.0, float("nan")]), (2, [7.0]), (3, [2.0, 3.0])], "id int, values array<double>")
    table = tables.zoned(packed, ["id"], M.Elf, {})
    assert sorted(r.id for r in tables.may_hold(table, 5.0).collect()) == [1, 2]
    single = {r.id: (r.least, r.most) for r in tables.zoned(packed.where("id > 1"), ["id"], M.SwingFilter, {"abs_error_bound": 0.1}).collect()}
    assert single[2] == (7.0, 7.0) and np.allclose(single[3], (2.0, 3.0))


def test_data_source(spark, points, tmp_path):
    points_format.register(spark)
    path = f"file://{tmp_path}/table"
    rows = series.compress(series.pack(points, ["id"], 9), M.Chimp64, {}).cache()
    for part in ("id < 7", "id >= 7"):
        rows.where(part).repartitionByRange(3, "id").write.format("loomline").mode("append").option("path", path).option("chunk", 9).save()
    table = spark.read.format("loomline").option("path", path).load()
    assert as_set(table) == as_set(points) and table.columns == ["id", "idx", "value"]
    reader = points_format.PushedReader(path, table.schema)
    files = len(reader.partitions())
    list(reader.pushFilters([points_format.EqualTo(("id",), 3), points_format.LessThan(("idx",), 5)]))
    assert 0 < len(reader.partitions()) < files
    decoded = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert decoded == 9  # one chunk of one key
    for where in ("id = 3 AND idx < 5", "id IN (2, 11) AND idx >= 30", "id > 20", "idx = 44", "value > 100 OR id < 1", "id IS NULL"):
        assert as_set(points_format.read_points(spark, path).where(where)) == as_set(points.where(where)), where
    assert spark.read.format("loomline").schema("id long, idx long").option("path", path).load().count() == points.count()
    rows.where("id = 5").write.format("loomline").mode("overwrite").option("path", path).option("chunk", 9).save()
    assert as_set(spark.read.format("loomline").option("path", path).load()) == as_set(points.where("id = 5"))
    table = spark.read.format("loomline").option("path", path).load()
    for where in ("id = 5 AND idx < 3", "value > 48 OR id < 1"):  # one frame for many queries
        assert as_set(table.where(where)) == as_set(points.where("id = 5").where(where))
    with pytest.raises(Exception, match="compressed rows need"):
        points.write.format("loomline").mode("append").option("path", path).save()


def test_table_functions(spark, points):
    udfs.register(spark)
    udfs.register_points(spark, "points_of_ids", "id bigint")
    points.repartition(3).createOrReplaceTempView("points")
    packed = "SELECT id, ts_pack(idx, value, 'Elf', '{}') AS payload FROM points GROUP BY id"
    assert as_set(spark.sql(f"SELECT id, t.idx, t.value FROM ({packed}) c, LATERAL ts_points(c.payload) t")) == as_set(points)
    assert as_set(spark.sql(f"SELECT * FROM points_of_ids(TABLE({packed}))")) == as_set(points)
    assert spark.sql("SELECT * FROM (SELECT CAST(NULL AS BINARY) AS p UNION ALL SELECT X'') c, LATERAL ts_points(c.p) t").count() == 0
