"""Series operators on DataFrames, native plans, SQL functions, stream operator and sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.functions import udfs
from loomline.methods import Method, SeriesError
from loomline.operators import series
from loomline.plans import native
from loomline.sources import tables
from loomline.streaming.online import online_midrange

M = Method


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(1)
    rows = [(k, i, float(v)) for k in ("a", "b", "c") for i, v in enumerate(np.round(np.cumsum(r.normal(0, 2, 60)), 2))]
    return spark.createDataFrame(rows, "id string, t int, value double")


def test_round_trip_and_chunks(points):
    p = series.to_points(points, ["id"], ["t"])
    for chunk in (None, 17):
        packed = series.pack(p, ["id"], chunk)
        back = series.unpack(series.decompress(series.compress(packed, M.Chimp64, {})), ["id"], chunk)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, p.collect()))


def test_nulls(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 3, 3.0)], "id string, t int, value double")
    assert [r.idx for r in series.to_points(df, ["id"], ["t"], nulls="drop").orderBy("idx").collect()] == [0, 1]
    with pytest.raises(Exception, match="null value"):
        series.to_points(df, ["id"], ["t"]).collect()


def test_permissive_and_checks(spark):
    packed = spark.createDataFrame([("a", [1.0, float("nan"), 2.0]), ("b", [1.0, 2.0, 3.0])], "id string, values array<double>")
    out = {r.id: r for r in series.compress(packed, M.SerfQT, {"abs_error_bound": 0.1}, permissive=True).collect()}
    assert out["a"].payload is None and out["a"].error_code == 2 and out["b"].error_code == 0
    with pytest.raises(SeriesError):
        series.compress(packed, M.SerfQT, {})


@pytest.mark.parametrize("m", [M.PoorMansCompressionMean, M.SwingFilter, M.SwingFilterDisconnected, M.SlidingWindow, M.VisvalingamWhyatt, M.PiecewiseLinearHistogram])
def test_segment_table_decodes_like_the_kernel(points, m):
    from loomline.queries import config

    packed = series.pack(series.to_points(points, ["id"], ["t"]), ["id"])
    payload = series.compress(packed, m, config(m))
    kernel = {(r.id, r.idx): r.value for r in series.unpack(series.decompress(payload), ["id"]).collect()}
    table = native.segment_table(series.extract(payload), ["id"], m)
    plan = {(r.id, r.idx): r.value for r in native.decode(table, ["id"]).collect()}
    assert plan.keys() == kernel.keys() and all(abs(plan[k] - kernel[k]) < 1e-9 for k in plan)


def test_rebuild(points):
    packed = series.pack(series.to_points(points, ["id"], ["t"]), ["id"])
    a = series.compress(packed, M.SlideFilter, {"abs_error_bound": 1.0})
    b = series.rebuild(series.extract(a), M.SlideFilter)
    assert sorted((r.id, bytes(r.payload)) for r in a.collect()) == sorted((r.id, bytes(r.payload)) for r in b.collect())


def test_runs_keep_nan_apart(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 1.0, float("nan"), float("nan"), 2.0])], "id string, idx long, value double")
    assert native.runs(df, ["id"]).count() == 4


def test_evaluate(points):
    p = series.to_points(points, ["id"], ["t"])
    r = series.evaluate(p, p.withColumn("value", F.col("value") + 1), ["id"], 1.5).first()
    assert r.n == r.n_decoded == 60 and abs(r.rmse - 1) < 1e-9 and r.within_bound


def test_sql_functions(spark):
    udfs.register(spark)
    r = spark.sql("""SELECT ts_decompress(ts_compress(array(1D, 2D, 3D), 'Elf', '{}')) AS v, ts_extract(ts_compress(array(1D, 1D, 5D), 'PoorMansCompressionMidrange', '{"abs_error_bound": 0.5}')) AS e""").first()
    assert r.v == [1, 2, 3] and r.e.indices == [2, 3] and r.e.coefficients == [1, 5]


def test_compressed_tables(spark, points, tmp_path):
    packed = series.pack(series.to_points(points, ["id"], ["t"]), ["id"])
    tables.write_compressed(series.compress(packed, M.Elf, {}), str(tmp_path / "x"))
    back = tables.read_compressed(spark, str(tmp_path / "x"), M.Elf)
    assert back.count() == 3 and series.decompress(back).count() == 3


def test_stream(spark, points, tmp_path):
    for k in range(2):
        points.where(F.col("t") % 60 < 60).where((F.col("t") >= 30 * k) & (F.col("t") < 30 * k + 30)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = online_midrange(stream, "id", "t", "value", 5.0).writeStream.format("memory").queryName("segments").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.id, r.start_idx, r.end_idx, r.value) for r in spark.sql("SELECT * FROM segments").collect())
    packed = series.pack(series.to_points(points, ["id"], ["t"]), ["id"])
    found = native.segment_table(series.extract(series.compress(packed, M.PoorMansCompressionMidrange, {"abs_error_bound": 5.0})), ["id"], M.PoorMansCompressionMidrange)
    want = sorted((r.id, r.start_idx, r.end_idx, r.c0) for r in found.collect() if r.end_idx < 60)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])


def test_permissive_verbs_and_refused_tables(spark):
    packed = spark.createDataFrame([(1, [1.0, 2.0, 4.0, 4.5]), (2, [7.0])], "id long, values array<double>")
    small = series.compress(packed, M.SwingFilter, {"abs_error_bound": 0.5})
    got = {r.id: r for r in series.extract(small, permissive=True).collect()}
    assert got[1].error_code == 0 and got[1].indices and got[2].error_code != 0 and got[2].indices is None and got[2].coefficients is None
    back = {r.id: r for r in series.rebuild(series.extract(small, permissive=True).drop("error_code"), M.SwingFilter, permissive=True).collect()}
    assert back[1].error_code == 0 and back[2].error_code != 0 and back[2].payload is None
    broken = small.withColumn("payload", F.when(F.col("id") == 1, F.col("payload")))
    assert {r.id: r.error_code == 0 for r in series.decompress(broken, permissive=True).collect()}[2]
    for method in (M.ABCLinearApproximation, M.SimPiece, M.MixPiece, M.NonLinearApproximation, M.DiscreteFourierTransform):
        with pytest.raises(SeriesError):
            native.segment_table(series.extract(small), ["id"], method)


def test_refused_series_stay_null(spark):
    packed = spark.createDataFrame([("a", [1.0, float("nan"), 2.0]), ("b", [1.0, 2.0, 3.0]), ("c", [4.0])], "id string, values array<double>")
    small = series.compress(packed, M.SerfQT, {"abs_error_bound": 0.1}, permissive=True)
    got = {r.id: (r["values"], r.error_code) for r in series.decompress(small, permissive=True).collect()}
    assert got["a"] == (None, 2) and got["b"][1] == 0 and got["c"] == ([4.0], 0)
    assert {r.id: r["values"] for r in series.decompress(small.drop("error_code")).collect()}["a"] is None


def test_segments_of_one_value(spark):
    packed = spark.createDataFrame([(1, [1.0, 2.0, 9.0]), (2, [7.0])], "id long, values array<double>")
    for m in (M.PoorMansCompressionMidrange, M.SwingFilter, M.SlidingWindow):
        from loomline.queries import config

        table = native.segments(series.compress(packed, m, config(m)), ["id"], m)
        assert [(r.seg, r.start_idx, r.end_idx, r.c0, r.c1) for r in table.where("id = 2").collect()] == [(0, 0, 1, 7.0, 7.0)]
        assert table.where("id = 1").agg(F.max("end_idx")).first()[0] == 3


def test_sql_functions_of_null(spark):
    udfs.register(spark)
    row = spark.sql("SELECT ts_extract(CAST(NULL AS BINARY)) AS e, ts_rebuild(CAST(NULL AS ARRAY<BIGINT>), CAST(NULL AS ARRAY<DOUBLE>), 'SwingFilter') AS r").first()
    assert row.r is None and (row.e is None or (row.e.indices is None and row.e.coefficients is None))


def test_compress_each(spark):
    packed = spark.createDataFrame([(1, [1.0, 2.0, 2.5]), (2, []), (3, None), (4, [7.0])], "id int, values array<double>")
    configs = {Method.Uncompressed: {}, Method.SwingFilter: {"abs_error_bound": 0.5}, Method.Elf: {}}
    got = {(r.id, r.method): (r.n, r.payload) for r in series.compress_each(packed, configs).collect()}
    assert len(got) == 12
    for m, c in configs.items():
        for r in series.compress(packed, m, c).collect():
            assert got[r.id, int(m)] == (r.n, r.payload)
    assert series.compress_each(packed.limit(0), configs).count() == 0


def passes(df):
    return sum("MapInArrow" in line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_chains_of_verbs_run_in_one_pass(points):
    from loomline import queries

    packed = series.pack(series.to_points(points, ["id"], ["t"]), ["id"])
    small = series.compress(packed, M.SwingFilter, {"abs_error_bound": 0.5})
    chain = series.decompress(series.extract(small, keep=True), keep=True)
    assert passes(chain) == 1 and set(chain.columns) == {"id", "method", "n", "payload", "indices", "coefficients", "values"}
    alone = {r.id: r["values"] for r in series.decompress(small.select("id", "payload")).collect()}
    assert {r.id: r["values"] for r in chain.collect()} == alone
    kept = small.persist()
    assert sorted(r.id for r in series.decompress(kept).collect()) == ["a", "b", "c"]
    kept.unpersist()
    each = series.compress_each(packed, {m: queries.config(m) for m in queries.MODELS})
    back = series.rebuild(series.extract(each, keep=True), into="rebuilt")
    assert passes(back) == 1
    rows = back.collect()
    assert len(rows) == 3 * len(queries.MODELS) and all(r.rebuilt == r.payload and r.payload[-1] == r.method for r in rows)


def test_queries_of_chains_run_in_one_pass(spark):
    from loomline import queries

    for f in (queries.extract_rebuild, lambda s, d: queries.sized(s, d, M.DiscreteFourierTransform, 10), lambda s, d: queries.bounded(s, d, M.SlideFilter)):
        assert passes(f(spark, "/root/testdata/sf0.001")) == 1
