"""Segments over a stream against the batch methods: ends, timers, late and refused points."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.methods import Method, SeriesError
from loomline.operators import series
from loomline.plans import native
from loomline.streaming import keyed

M = Method
START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


@pytest.mark.parametrize("method,bound", [(M.RunLengthEncoding, 0.0), (M.SwingFilter, 2.0), (M.SwingFilterDisconnected, 2.0), (M.PoorMansCompressionMidrange, 3.0)])
def test_stream_is_the_batch(spark, tmp_path, method, bound):
    r = np.random.default_rng(6)
    data = {k: np.round(np.cumsum(r.normal(0, 1, n))) for k, n in (("a", 90), ("b", 2), ("c", 1), ("d", 41))}
    table = spark.createDataFrame([(k, at(i), i, float(v)) for k, vs in data.items() for i, v in enumerate(vs)], "id string, ts timestamp, tie long, value double")
    stream = keyed.replay(spark, table, "ts", 3, str(tmp_path / "in"))
    got = keyed.drain(keyed.stream_segments(stream, ["id"], "ts", "tie", "value", method, bound), str(tmp_path / "w"))
    points = series.to_points(table, ["id"], ["ts", "tie"])
    if method is M.RunLengthEncoding:
        want = native.runs(points, ["id"])
    else:
        packed = series.pack(points.where("id <> 'c'"), ["id"])
        want = native.segment_table(series.extract(series.compress(packed, method, {"abs_error_bound": bound})), ["id"], method)
    key = lambda x: (x.id, x.start_idx, x.end_idx, round(x.c0, 9), round(x.c1, 9))
    found = got.collect()
    assert sorted(key(x) for x in found if x.id != "c") == sorted(key(x) for x in want.collect() if x.id != "c")
    assert [(x.start_idx, x.end_idx) for x in found if x.id == "c"] == [(0, 1)] and not sum(x.refused for x in found)


def test_timers_and_refused_points(spark, tmp_path):
    batches = [
        [("a", at(0), 0, 1.0), ("a", at(1), 1, 1.0), ("b", at(0), 0, 7.0)],
        [("a", at(0.5), 2, 9.0), ("a", at(2), 3, None), ("a", at(2), 4, float("nan")), ("a", at(3), 5, 1.0)],  # behind the last point; not a number
        [("b", at(5000), 6, 8.0)],  # the watermark passes a and b
        [("a", at(9000), 7, 2.0)],
        [(None, at(99000), None, None)],
        [(None, at(99999), None, None)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, "id string, ts timestamp, tie long, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, ts timestamp, tie long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = keyed.drain(keyed.stream_segments(stream, ["id"], "ts", "tie", "value", M.RunLengthEncoding), str(tmp_path / "w"))
    rows = sorted((x.id, x.start_idx, x.end_idx, x.c0, x.refused) for x in got.collect())
    assert [x for x in rows if x[0] == "a"] == [("a", 0, 1, 2.0, 0), ("a", 0, 3, 1.0, 3)]
    assert [x for x in rows if x[0] == "b"] == [("b", 0, 1, 7.0, 0), ("b", 0, 1, 8.0, 0)]


def test_other_methods_are_refused(spark):
    with pytest.raises(SeriesError):
        keyed.stream_segments(spark.range(1), ["id"], "id", "id", "id", M.Chimp64)


class Handle:
    """State and timers of one key in memory, and how often each was called."""

    def __init__(self):
        self.held, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.held

    def update(self, x):
        self.held = x

    def clear(self):
        self.held = None

    def registerTimer(self, at):
        self.timers.append(at)


class Now:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_a_key_has_one_timer():
    from pyspark.sql import Row

    for method, c1 in ((M.RunLengthEncoding, 7.0), (M.SwingFilterDisconnected, 7.0)):
        p, h = keyed.Segments(*keyed._step(method, 1.0), "value", 1000, ["id", "start_idx", "end_idx", "c0", "c1", "refused"]), Handle()
        p.init(h)
        for batch in range(3):  # the rows of a batch in any order
            rows = [Row(ts=(batch * 10 + i) * 100_000, tie=i, value=7.0) for i in (2, 0, 1)]
            assert not list(p.handleInputRows(("a",), iter(rows), Now(0)))
        assert h.timers == [1200]
        # points have come since, so the timer is set again; then the watermark is past them
        assert not list(p.handleExpiredTimer(("a",), Now(1300), None)) and h.timers == [1200, 3200]
        assert [tuple(x) for x in p.handleExpiredTimer(("a",), Now(3200), None)] == [("a", 0, 9, 7.0, c1, 0)] and h.held is None


class Listed(Handle):
    """State of a bucket in memory."""

    def getListState(self, name, schema):
        self.held, self.fields = [], len(schema.fields)
        return self

    def get(self):
        self.calls += 1
        return iter(self.held)

    def put(self, rows):
        self.calls += 1
        assert all(len(x) == self.fields for x in rows)
        self.held = rows

    def clear(self):
        self.calls += 1
        self.held = []


def test_a_bucket_is_one_state():
    from pyspark.sql import Row
    from pyspark.sql import types as T

    each = keyed.Segments(*keyed._step(M.RunLengthEncoding, 0.0), "value", 10_000, ["id", "start_idx", "end_idx", "c0", "c1", "refused"])
    p, h = keyed.Buckets(each, ["id"], [T.DoubleType()]), Listed()
    p.init(h)
    keys = [None, *(float(i) for i in range(50)), float("nan")]
    row = lambda k, second, tie, v: Row(id=k, ts=second * 1_000_000, tie=tie, value=v)
    assert not list(p.handleInputRows((1,), iter([row(k, 5, 0, 7.0) for k in keys]), Now(0)))
    # all go on but the last two, whose value changes; NaN is the same key again
    out = list(p.handleInputRows((1,), iter([row(float("nan") if k != k else k, 9, 1, 7.0 if i < 50 else 8.0) for i, k in enumerate(keys)]), Now(0)))
    assert [tuple(x)[1:] for x in out] == [(0, 1, 7.0, 7.0, 0)] * 2
    assert h.calls == 4 and h.timers == [15000] and len(h.held) == 52
    # a key that is due before all others brings the timer forward
    assert not list(p.handleInputRows((1,), iter([row(-1.0, 2, 2, 1.0)]), Now(0))) and h.timers == [15000, 12000]
    assert [tuple(x) for x in p.handleExpiredTimer((1,), Now(12000), None)] == [(-1.0, 0, 1, 1.0, 1.0, 0)]
    assert h.timers == [15000, 12000, 19000] and len(h.held) == 52
    assert not list(p.handleExpiredTimer((1,), Now(15000), None)) and len(h.held) == 52
    assert len(list(p.handleExpiredTimer((1,), Now(19000), None))) == 52 and not h.held
    assert h.timers[-1] == 19000
