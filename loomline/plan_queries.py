"""The registered queries of plans over compressed tables: long series, streams, joins."""

from __future__ import annotations

import json
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as base
from .functions import udfs
from .kernels.segments import margin
from .methods import Method
from .operators import asof, series
from .plans import fourier, greedy, intervals, native, piecewise, sizes
from .queries import BOUND, KEY, PTS, TERMS
from .sources import format as points_format
from .sources import tables
from .sources.staging import Staging
from .streaming import keyed

M = Method
#: Bound of the one long series: all events in order of time.
LONG_BOUND = 100.0
HOUR = 3_600_000_000
#: Added before values are rounded that can lie half-way between two results.
OFF_TIES = 3.3e-7
#: How far back a value counts in as-of joins, and the width of the spans of their windows (microseconds).
TOLERANCE, WIDTH = 72 * HOUR, 240 * HOUR


def read_events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(*columns)


def long_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one series, in greedy midrange segments."""
    staging = Staging(spark)
    rows = read_events(spark, sf_dir, "ts", "event_id", "value").withColumn("series", F.lit("all"))
    points = greedy.numbered(rows, ["series"], ["ts", "event_id"], staging=staging)
    found = greedy.midrange_segments(points, ["series"], LONG_BOUND, staging=staging)
    return found.select("start_idx", "end_idx", F.round((F.col("lo") + F.col("hi")) / 2, 6).alias("value"))


LONG_SEGMENTS_SQL = f"""WITH RECURSIVE pts AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, value FROM events),
r AS (
  SELECT idx, value AS lo, value AS hi, idx AS s FROM pts WHERE idx = 0
  UNION ALL
  SELECT i, CASE WHEN cut THEN v ELSE least(lo, v) END, CASE WHEN cut THEN v ELSE greatest(hi, v) END, CASE WHEN cut THEN i ELSE s END
  FROM (SELECT r.*, p.idx AS i, p.value AS v, greatest(r.hi, p.value) - least(r.lo, p.value) > {2 * LONG_BOUND} AS cut FROM r JOIN pts p ON p.idx = r.idx + 1)
) SELECT s AS start_idx, max(idx) + 1 AS end_idx, round((min(lo) + max(hi)) / 2, 6) AS value FROM r GROUP BY s"""


def streamed(spark: SparkSession, sf_dir: str, method: Method, bound: float) -> DataFrame:
    """Segments of each user as a stream of files gives them."""
    path = Staging(spark).root
    table = read_events(spark, sf_dir, "user_id", "ts", "event_id", "value")
    year = 366 * 24 * HOUR // 1000
    stream = keyed.replay(spark, table, "ts", 3, f"{path}/in", after_days=400)
    return keyed.drain(keyed.stream_segments(stream, KEY, "ts", "event_id", "value", method, bound, idle_ms=year), path).select(*KEY, "start_idx", "end_idx", F.round("c0", 4).alias("c0"), (F.round("c1", 4) + 0.0).alias("c1"), "refused")


STREAM_RUNS_SQL = f"""WITH {PTS}, m AS (
  SELECT *, CASE WHEN lag(value) OVER w IS NULL OR lag(value) OVER w <> value THEN 1 ELSE 0 END AS new FROM pts WINDOW w AS (PARTITION BY user_id ORDER BY idx)
), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY idx) AS seg FROM m)
SELECT user_id, min(idx) AS start_idx, max(idx) + 1 AS end_idx, min(value) AS c0, min(value) AS c1, 0::BIGINT AS refused FROM s GROUP BY user_id, seg"""
#: The disjoint swing's cones, point by point, as in the batch query; here each cone is one row.
_CONES = base._swing_sql(False).rsplit(" SELECT r.user_id", 1)[0]
STREAM_SWING_SQL = f"{_CONES} SELECT r.user_id, min(r.s) AS start_idx, max(r.idx) + 1 AS end_idx, round(min(r.vs), 4) AS c0, round(min(CASE WHEN last = r.s THEN r.vs ELSE stop END), 4) + 0.0 AS c1, 0::BIGINT AS refused FROM r JOIN e ON e.user_id = r.user_id AND e.seg = r.seg GROUP BY r.user_id, r.seg"


def _two_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values compressed in two ways, put together by segments."""
    tables = [intervals.disjoint(native.segments(base.payloads(spark, sf_dir, m), KEY, m), KEY) for m in (M.PoorMansCompressionMidrange, M.SwingFilterDisconnected)]
    return intervals.combine(intervals.overlap(*tables, KEY), KEY)


def interval_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.combined_points(_two_sides(spark, sf_dir), KEY).select(*KEY, "idx", *((F.round(F.col(c) + OFF_TIES, 4) + 0.0).alias(c) for c in ("total", "difference", "product")))


def interval_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.combined_sums(_two_sides(spark, sf_dir), KEY).select(*KEY, "n", *((F.round(F.col(c) + OFF_TIES, 2) + 0.0).alias(c) for c in ("total", "difference", "product")))


#: The decoded values of both sides, from the events.
_BOTH = f"""FROM (WITH RECURSIVE {base._MIDRANGE} SELECT r.user_id, r.idx, s.value FROM r JOIN s ON r.user_id = s.user_id AND r.seg = s.seg) a
JOIN ({base._swing_sql(False).replace("round(CASE", "(CASE").replace("END, 4) + 0.0 AS value", "END) AS value")}) b USING (user_id, idx)"""
INTERVAL_POINTS_SQL = f"SELECT user_id, idx, round(a.value + b.value + {OFF_TIES}, 4) + 0.0 AS total, round(a.value - b.value + {OFF_TIES}, 4) + 0.0 AS difference, round(a.value * b.value + {OFF_TIES}, 4) + 0.0 AS product {_BOTH}"
INTERVAL_SUMS_SQL = f"SELECT user_id, count(*) AS n, round(sum(a.value + b.value) + {OFF_TIES}, 2) + 0.0 AS total, round(sum(a.value - b.value) + {OFF_TIES}, 2) + 0.0 AS difference, round(sum(a.value * b.value) + {OFF_TIES}, 2) + 0.0 AS product {_BOTH} GROUP BY user_id"


def _timed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = read_events(spark, sf_dir, "user_id", "event_id", "ts", "event_type", "value").where(F.col("event_type") == kind)
    return rows.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")


def asof_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's last view at or before it."""
    found = asof.asof_join(_timed(spark, sf_dir, "purchase"), _timed(spark, sf_dir, "view").drop("event_id"), KEY, "t", {"value": "view_value"}, TOLERANCE, WIDTH, time="view_t")
    return found.select("user_id", "event_id", "value", "view_value", F.coalesce(F.col("t") - F.col("view_t"), F.lit(-1)).alias("gap"))


_KIND = "(SELECT user_id, event_id, epoch_us(ts) AS t, value FROM events WHERE event_type = '{}')"
ASOF_VIEWS_SQL = f"""SELECT a.user_id, a.event_id, a.value, CASE WHEN a.t - b.t <= {TOLERANCE} THEN b.value END AS view_value, CASE WHEN a.t - b.t <= {TOLERANCE} THEN a.t - b.t ELSE -1 END AS gap
FROM {_KIND.format("purchase")} a ASOF LEFT JOIN {_KIND.format("view")} b ON a.user_id = b.user_id AND a.t >= b.t"""


def aligned_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A multivariate series of each user: the last known value of each kind of event at each event's time."""
    kinds = ("view", "click", "purchase", "signup", "error")
    return asof.align_series({k: _timed(spark, sf_dir, k) for k in kinds}, KEY, "t", "value", TOLERANCE, WIDTH)


def _known(kind: str) -> str:
    value, time = (f"last_value(CASE WHEN event_type = '{kind}' THEN {c} END IGNORE NULLS) OVER w" for c in ("value", "t"))
    return f"CASE WHEN t - {time} <= {TOLERANCE} THEN {value} END AS {kind}"


ALIGNED_KINDS_SQL = f"""WITH e AS (SELECT user_id, event_type, epoch_us(ts) AS t, max(value) AS value FROM events GROUP BY ALL),
k AS (SELECT user_id, t, {", ".join(map(_known, ("view", "click", "purchase", "signup", "error")))} FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT DISTINCT * FROM k"""

def _pieces(spark: SparkSession, sf_dir: str, method: Method) -> DataFrame:
    return piecewise.piece_table(series.extract(base.payloads(spark, sf_dir, method)), KEY, method)


def piece_points(spark: SparkSession, sf_dir: str, method: Method) -> DataFrame:
    """A range of indices from the pieces that meet it."""
    return piecewise.decode(_pieces(spark, sf_dir, method), KEY, 10, 40).select(*KEY, "idx", (F.round(F.col("value") + OFF_TIES, 4) + 0.0).alias("value"))


def piece_sums(spark: SparkSession, sf_dir: str, method: Method) -> DataFrame:
    """Count, sum and extremes of each series from its pieces."""
    return piecewise.aggregate(_pieces(spark, sf_dir, method), KEY).select(*KEY, "n", *((F.round(F.col(c) + OFF_TIES, 3) + 0.0).alias(c) for c in ("total", "least", "most")))


_INF = "'infinity'::DOUBLE"


def _pieces_sql(both: bool) -> str:
    """Cones from intercepts on the grid of the bound (below; or also above, whichever reaches further), then groups of overlapping slopes.

    Ends in d (user_id, idx, value). With both intercepts a cone that is alone in its group of one intercept is grouped with others of its kind.
    """
    eb, slack = f"{margin(BOUND)!r}::DOUBLE", f"{BOUND - margin(BOUND)!r}::DOUBLE"
    down, up = f"floor(v / {BOUND}) * {BOUND} + {slack}", f"ceil(v / {BOUND}) * {BOUND} - {slack}"
    sides = {"1": down, "2": up} if both else {"1": down}
    fits = {k: f"(on{k} AND (p.idx = s + 1 OR (lo{k} * (p.idx - s) + b{k} - {eb} <= p.value AND p.value <= hi{k} * (p.idx - s) + b{k} + {eb})))" for k in sides}
    cut = f"NOT ({' OR '.join(fits.values())})"
    begin = ", ".join(f"{b} AS b{k}, TRUE AS on{k}, -{_INF} AS lo{k}, {_INF} AS hi{k}" for k, b in sides.items()).replace("(v /", "(value /")
    steps = ", ".join(
        f"CASE WHEN cut THEN {b} ELSE b{k} END, cut OR fit{k}, CASE WHEN cut THEN -{_INF} WHEN fit{k} THEN greatest(lo{k}, (v - {eb} - b{k}) / (i - s)) ELSE lo{k} END, CASE WHEN cut THEN {_INF} WHEN fit{k} THEN least(hi{k}, (v + {eb} - b{k}) / (i - s)) ELSE hi{k} END" for k, b in sides.items()
    )
    # the upper intercept only if it alone is left
    pick = lambda c: f"CASE WHEN on2 AND NOT on1 THEN {c}2 ELSE {c}1 END" if both else f"{c}1"
    ctes = [
        PTS,
        f"""z AS (
  SELECT user_id, idx, idx AS s, {begin} FROM pts WHERE idx = 0
  UNION ALL
  SELECT user_id, i, CASE WHEN cut THEN i ELSE s END, {steps}
  FROM (SELECT z.*, p.idx AS i, p.value AS v, {cut} AS cut, {", ".join(f"{f} AS fit{k}" for k, f in fits.items())}
        FROM z JOIN pts p ON p.user_id = z.user_id AND p.idx = z.idx + 1))""",
        f"c AS (SELECT user_id, s, {pick('b')} AS b, CASE WHEN idx = s THEN 0 ELSE {pick('lo')} END AS lo, CASE WHEN idx = s THEN 0 ELSE {pick('hi')} END AS hi FROM z QUALIFY row_number() OVER (PARTITION BY user_id, s ORDER BY idx DESC) = 1)",
        _merge_sql("g", "SELECT *, b AS part FROM c"),
    ]
    if both:
        ctes += [_merge_sql("h", "SELECT user_id, s, b, lo, hi, 0.0::DOUBLE AS part FROM g WHERE size = 1"), "m AS (SELECT user_id, s, b, slope FROM g WHERE size > 1 UNION ALL SELECT user_id, s, b, slope FROM h)"]
    else:
        ctes.append("m AS (SELECT user_id, s, b, slope FROM g)")
    ctes.append("d AS (SELECT p.user_id, p.idx, m.slope * (p.idx - m.s) + m.b AS value FROM pts p ASOF JOIN m ON m.user_id = p.user_id AND p.idx >= m.s)")
    return "WITH RECURSIVE " + ", ".join(ctes)


def _merge_sql(name: str, rows: str) -> str:
    """Cones in order of their lower slope, each with the group so far if it overlaps; slope is the middle of what the group shares."""
    return f"""{name}o AS (SELECT *, row_number() OVER (PARTITION BY user_id, part ORDER BY lo, s) AS k FROM ({rows})),
{name}r AS (
  SELECT user_id, part, s, b, lo, hi, k, lo AS glo, hi AS ghi, 0 AS grp FROM {name}o WHERE k = 1
  UNION ALL
  SELECT o.user_id, o.part, o.s, o.b, o.lo, o.hi, o.k, CASE WHEN o.lo <= ghi AND o.hi >= glo THEN greatest(glo, o.lo) ELSE o.lo END, CASE WHEN o.lo <= ghi AND o.hi >= glo THEN least(ghi, o.hi) ELSE o.hi END, grp + (NOT (o.lo <= ghi AND o.hi >= glo))::INT
  FROM {name}r q JOIN {name}o o ON o.user_id = q.user_id AND o.part = q.part AND o.k = q.k + 1
),
{name} AS (SELECT user_id, s, b, lo, hi, (max(glo) OVER w + min(ghi) OVER w) / 2 AS slope, count(*) OVER w AS size FROM {name}r WINDOW w AS (PARTITION BY user_id, part, grp))"""


def _piece_points_sql(both: bool) -> str:
    return f"{_pieces_sql(both)} SELECT user_id, idx, round(value + {OFF_TIES}, 4) + 0.0 AS value FROM d WHERE idx >= 10 AND idx < 40"


def _piece_sums_sql(both: bool) -> str:
    return f"{_pieces_sql(both)} SELECT user_id, count(*) AS n, round(sum(value) + {OFF_TIES}, 3) + 0.0 AS total, round(min(value) + {OFF_TIES}, 3) + 0.0 AS least, round(max(value) + {OFF_TIES}, 3) + 0.0 AS most FROM d GROUP BY user_id"


def _piece_values_sql(both: bool) -> str:
    return f"{_pieces_sql(both)} SELECT user_id, idx, round(value + {OFF_TIES}, 4) + 0.0 AS value FROM d"


def piece_values(spark: SparkSession, sf_dir: str, method: Method) -> DataFrame:
    """Each decoded value of the payloads."""
    return base.round_trip(spark, sf_dir, method).withColumn("value", F.round(F.col("value") + OFF_TIES, 4) + 0.0)


def _rounded(*columns: str, places: int = 4) -> list:
    return [(F.round(F.col(c) + OFF_TIES, places) + 0.0).alias(c) for c in columns]


def long_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest frequencies of all events as one series."""
    rows = read_events(spark, sf_dir, "ts", "event_id", "value").withColumn("series", F.lit("all"))
    found = fourier.strongest(fourier.terms(greedy.numbered(rows, ["series"], ["ts", "event_id"]), ["series"]), ["series"], TERMS)
    return found.select("n", "k", *_rounded("re", "im", places=3))


_TERMS_SQL = """t AS (SELECT user_id, n, k, sum(value * cos(2 * pi() * (k * idx % n) / n)) AS re, -sum(value * sin(2 * pi() * (k * idx % n) / n)) AS im FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM n) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (k > 0)::INT, round(re * re + im * im, 4) DESC, k) AS r FROM t)"""
LONG_SPECTRUM_SQL = f"""WITH n AS (SELECT 1 AS user_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, value, count(*) OVER () AS n FROM events), {_TERMS_SQL}
SELECT n, k, round(re + {OFF_TIES}, 3) + 0.0 AS re, round(im + {OFF_TIES}, 3) + 0.0 AS im FROM o WHERE r <= {TERMS}"""


def _kept_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fourier.term_table(series.extract(base.payloads(spark, sf_dir, M.DiscreteFourierTransform)), KEY)


def dft_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value of each series from all of its terms."""
    return fourier.values(fourier.terms(base.points(spark, sf_dir), KEY), KEY).select(*KEY, "idx", *_rounded("value"))


DFT_RECONSTRUCT_SQL = f"WITH {PTS} SELECT user_id, idx, round(value + {OFF_TIES}, 4) + 0.0 AS value FROM pts"


def dft_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of indices from the kept terms."""
    return fourier.values(_kept_terms(spark, sf_dir), KEY, 10, 40).select(*KEY, "idx", *_rounded("value"))


_KEPT_SQL = f"""WITH {PTS}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM pts), {_TERMS_SQL},
d AS (SELECT n.user_id, n.idx, any_value(n.value) AS raw, any_value(n.n) AS n, sum(CASE WHEN k = 0 OR 2 * k = n.n THEN 1 ELSE 2 END * (re * cos(2 * pi() * (k * idx % n.n) / n.n) - im * sin(2 * pi() * (k * idx % n.n) / n.n)) / n.n) AS value FROM n JOIN o ON o.user_id = n.user_id AND o.r <= {TERMS} GROUP BY n.user_id, n.idx)"""
DFT_POINTS_SQL = f"{_KEPT_SQL} SELECT user_id, idx, round(value + {OFF_TIES}, 4) + 0.0 AS value FROM d WHERE idx >= 10 AND idx < 40"


def dft_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over a range of indices, and what the kept terms lose, from the terms and each series' sum of squares."""
    table = _kept_terms(spark, sf_dir)
    energy = base.points(spark, sf_dir).groupBy(*KEY).agg(F.sum(F.col("value") * F.col("value")).alias("energy"))
    out = fourier.range_sums(table, KEY, 5, 55).join(fourier.lost(table, KEY, energy), KEY)
    return out.select(*KEY, "n", "count", *_rounded("total", "rmse"))


DFT_SUMS_SQL = f"{_KEPT_SQL} SELECT user_id, min(n) AS n, count(*) FILTER (idx >= 5 AND idx < 55) AS count, round(sum(value) FILTER (idx >= 5 AND idx < 55) + {OFF_TIES}, 4) + 0.0 AS total, round(sqrt(avg((value - raw) ** 2)) + {OFF_TIES}, 4) + 0.0 AS rmse FROM d GROUP BY user_id"

#: Points of a chunk, and the values that are looked for.
CHUNK, LOW, HIGH = 16, 240.0, 300.0


def _zoned(spark: SparkSession, sf_dir: str, method: Method) -> DataFrame:
    """A zoned table of all events, written and read again."""
    rows = tables.zoned(series.pack(base.points(spark, sf_dir), KEY, CHUNK), [*KEY, series.CHUNK], method, base.config(method))
    return Staging(spark).put(rows)


def zone_maps(spark: SparkSession, sf_dir: str, method: Method) -> DataFrame:
    """Each chunk's count and extremes, and whether it has to be decoded for the values looked for."""
    rows = _zoned(spark, sf_dir, method)
    needed = tables.may_hold(rows, LOW, HIGH).select(*KEY, series.CHUNK, F.lit(True).alias("needed"))
    out = rows.join(needed, [*KEY, series.CHUNK], "left")
    return out.select(*KEY, series.CHUNK, "n", *_rounded("least", "most"), F.coalesce("needed", F.lit(False)).alias("needed"))


def value_filter(spark: SparkSession, sf_dir: str, method: Method) -> DataFrame:
    """The points of a range of values, from the chunks that can hold them."""
    return tables.values_between(_zoned(spark, sf_dir, method), KEY, LOW, HIGH, CHUNK).select(*KEY, "idx", *_rounded("value"))


def _zones_sql(points: str) -> str:
    return f"""WITH {points} SELECT user_id, idx // {CHUNK} AS chunk, count(*) AS n, round(min(value) + {OFF_TIES}, 4) + 0.0 AS least, round(max(value) + {OFF_TIES}, 4) + 0.0 AS most, max(value) >= {LOW} AND min(value) <= {HIGH} AS needed
FROM pts GROUP BY user_id, idx // {CHUNK}"""


def _filter_sql(points: str) -> str:
    return f"WITH {points} SELECT user_id, idx, round(value + {OFF_TIES}, 4) + 0.0 AS value FROM pts WHERE value BETWEEN {LOW} AND {HIGH}"


#: The events in midrange segments that start anew at each chunk, decoded.
_CHUNKED = f"""raw AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value AS v FROM events),
r AS (
  SELECT user_id, idx, v, v AS lo, v AS hi, 0 AS seg FROM raw WHERE idx = 0
  UNION ALL
  SELECT user_id, i, x, CASE WHEN cut THEN x ELSE least(lo, x) END, CASE WHEN cut THEN x ELSE greatest(hi, x) END, seg + cut::INT
  FROM (SELECT r.*, p.idx AS i, p.v AS x, p.idx % {CHUNK} = 0 OR greatest(r.hi, p.v) - least(r.lo, p.v) > {2 * BOUND} AS cut FROM r JOIN raw p ON p.user_id = r.user_id AND p.idx = r.idx + 1)
), pts AS (SELECT user_id, idx, (min(v) OVER w + max(v) OVER w) / 2 AS value FROM r WINDOW w AS (PARTITION BY user_id, seg))"""


def source_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed events written to and read from the data source, with filters that leave out files and chunks."""
    points_format.register(spark)
    path = f"{Staging(spark).root}/points"
    rows = series.compress(series.pack(base.points(spark, sf_dir), KEY, CHUNK), M.Chimp128, {})
    rows.repartitionByRange(*KEY).write.format("loomline").mode("append").option("path", path).option("chunk", CHUNK).save()
    return points_format.read_points(spark, path).where((F.col("user_id") >= 20) & (F.col("user_id") < 90) & (F.col("idx") >= 5) & (F.col("idx") < 50))


SOURCE_POINTS_SQL = f"WITH {PTS} SELECT user_id, idx, value FROM pts WHERE user_id >= 20 AND user_id < 90 AND idx >= 5 AND idx < 50"


def sql_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed and unpacked in SQL alone: an aggregate, and a lateral table function."""
    udfs.register(spark)
    read_events(spark, sf_dir, "user_id", "ts", "event_id", "value").createOrReplaceTempView("loomline_events")
    config = base.config(M.SwingFilterDisconnected)
    return spark.sql(f"""WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value FROM loomline_events),
      c AS (SELECT user_id, ts_pack(i, value, 'SwingFilterDisconnected', '{json.dumps(config)}') AS payload FROM p GROUP BY user_id)
      SELECT user_id, t.idx, round(t.value + {OFF_TIES}, 4) + 0D AS value FROM c, LATERAL ts_points(c.payload) t""")


SQL_ROUND_TRIP_SQL = base._swing_sql(False).replace("END, 4) + 0.0 AS value", f"END + {OFF_TIES}, 4) + 0.0 AS value")

def lossless_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each lossless method on each series, from expressions over its values, and whether its payload has as many."""
    found = sizes.lossless_sizes(base.points(spark, sf_dir), KEY)
    made = base.payload_bytes(spark, sf_dir, base.LOSSLESS).select(*KEY, "method", F.col("bytes").alias("made"))
    return found.join(made, [*KEY, "method"]).select(*KEY, "method", "n", "bytes", (F.col("bytes") == F.col("made")).alias("same"))


def _bits_sql(v: str) -> str:
    """The bits of a double that is not negative."""
    e = f"(floor(log2({v}))::INT - CASE WHEN pow(2.0, floor(log2({v}))) > {v} THEN 1 ELSE 0 END + CASE WHEN pow(2.0, floor(log2({v})) + 1) <= {v} THEN 1 ELSE 0 END)"
    return f"(CASE WHEN {v} = 0 THEN 0::BIGINT ELSE (({e} + 1023)::BIGINT << 52) | (({v} / pow(2.0, {e}) - 1) * 4503599627370496)::BIGINT END)"


_LEAD, _TRAIL = "(64 - length(bin({0})))", "(length(bin({0})) - length(rtrim(bin({0}), '0')))"
_STEP_SQL = "(CASE WHEN {0} >= 24 THEN 24 WHEN {0} >= 22 THEN 22 WHEN {0} >= 20 THEN 20 WHEN {0} >= 18 THEN 18 WHEN {0} >= 16 THEN 16 WHEN {0} >= 12 THEN 12 WHEN {0} >= 8 THEN 8 ELSE 0 END)"


def _chimp_sql(name: str, ring: bool) -> str:
    """Windows of XOR codes; ``ring``: a value of the same low 14 bits within 128 places may be the predecessor."""
    slot, least = (7, 13) if ring else (0, 6)
    ref = "CASE WHEN idx - 1 - coalesce(far_idx, 0) < 128 AND (xor(coalesce(far, start), raw) = 0 OR " + _TRAIL.format("xor(coalesce(far, start), raw)") + " > 13) THEN coalesce(far, start) END" if ring else "NULL::BIGINT"
    return f"""{name}1 AS (SELECT *, {ref} AS ref FROM v WHERE idx > 0),
{name}2 AS (SELECT user_id, idx, n, xor(coalesce(ref, prev), raw) AS x, ref FROM {name}1),
{name}3 AS (SELECT *, {_TRAIL.format("x")} AS t, 64 - {_STEP_SQL.format(_LEAD.format("x"))} AS body FROM {name}2),
{name}4 AS (SELECT *, x <> 0 AND {"ref IS NOT NULL" if ring else f"t > {least}"} AS cut FROM {name}3),
{name}5 AS (SELECT *, lag(CASE WHEN x <> 0 AND NOT cut THEN body END) OVER (PARTITION BY user_id ORDER BY idx) AS held FROM {name}4),
{name} AS (SELECT user_id, 9 + ceil((sum(CASE WHEN x = 0 THEN {2 + slot} WHEN cut THEN {11 + slot} + body - t WHEN held = body THEN 2 + body ELSE 5 + body END) + {11 + slot}) / 8) AS bytes FROM {name}5 GROUP BY user_id)"""


def lossless_sql() -> str:
    tagged = "(CASE WHEN {0} < 256 THEN 10 WHEN {0} < 65536 THEN 18 WHEN {0} < 4294967296 THEN 34 ELSE 66 END)"
    double = "(pow(2.0, (({0} >> 52) - 1023)::INT) * (1 + ({0} & 4503599627370495) / 4503599627370496.0::DOUBLE))"
    return f"""WITH RECURSIVE {PTS}, b AS (SELECT *, {_bits_sql("value")} AS raw, count(*) OVER (PARTITION BY user_id) AS n FROM pts),
v AS (SELECT *, lag(raw) OVER w AS prev, first_value(raw) OVER w AS start, lag(raw) OVER k AS far, lag(idx) OVER k AS far_idx FROM b WINDOW w AS (PARTITION BY user_id ORDER BY idx), k AS (PARTITION BY user_id, raw & 16383 ORDER BY idx)),
runs AS (SELECT user_id, 16 * count(*) FILTER (prev IS NULL OR prev <> raw) + 1 AS bytes FROM v GROUP BY user_id),
{_chimp_sql("c", False)},
{_chimp_sql("g", True)},
-- decimal places and digits: the least power of ten that makes a whole number which gives the value back
p AS (SELECT *, list_filter(range(0, 21), lambda k: round(value * pow(10.0, k)) / pow(10.0, k) = value AND round(value * pow(10.0, k)) < 9007199254740992)[1] AS places FROM v),
q AS (SELECT *, CASE WHEN value > 0 THEN round(value * pow(10.0, places))::BIGINT::VARCHAR END AS m FROM p),
d AS (SELECT * EXCLUDE (places), places - z AS places, length(m) - z AS digits FROM (SELECT *, CASE WHEN places = 0 THEN length(m) - length(rtrim(m, '0')) ELSE 0 END AS z FROM q)),
w AS (SELECT user_id, idx, n, value, pow(10.0, least(15, max(greatest(places, 0)) FILTER (digits <= 15) OVER (PARTITION BY user_id))) AS scale FROM d),
s AS (SELECT user_id, idx, n, round(value * coalesce(scale, 1))::BIGINT - lag(round(value * coalesce(scale, 1))::BIGINT) OVER (PARTITION BY user_id ORDER BY idx) AS step FROM w),
delta AS (SELECT user_id, 29 + ceil(coalesce(sum({tagged.format("(step - least_step)")}) FILTER (step IS NOT NULL), 0) / 8) AS bytes FROM (SELECT *, min(step) OVER (PARTITION BY user_id) AS least_step FROM s) GROUP BY user_id),
-- bits that the digits give back are cut off
e AS (SELECT *, 52 - ceil(places * log2(10.0)) - ((raw >> 52) - 1023) AS cut FROM d),
f AS (SELECT *, CASE WHEN idx > 0 AND digits <= 15 AND places >= 0 AND cut > 4 AND cut < 64 THEN (raw >> cut::INT) << cut::INT END AS short FROM e),
h AS (SELECT *, {double.format("short")} AS back FROM f),
i AS (SELECT *, floor(log10(back))::INT - CASE WHEN pow(10.0, floor(log10(back))) > back THEN 1 ELSE 0 END + CASE WHEN pow(10.0, floor(log10(back)) + 1) <= back THEN 1 ELSE 0 END AS f10 FROM h),
j AS (SELECT *, short <> raw AND coalesce(CASE WHEN digits = 1 AND places > 0 AND value = pow(10.0, -places) THEN pow(10.0, f10 + 1) ELSE ceil(back * pow(10.0, digits - f10 - 1)) / pow(10.0, digits - f10 - 1) END = value, FALSE) AS marked FROM i),
k AS (SELECT user_id, idx, n, coalesce(marked, FALSE) AS marked, CASE WHEN marked THEN short ELSE raw END AS stored FROM j),
x AS (SELECT *, xor(stored, lag(stored) OVER (PARTITION BY user_id ORDER BY idx)) AS x FROM k),
y AS (SELECT *, {_STEP_SQL.format(_LEAD.format("x"))} AS lead, {_TRAIL.format("x")} AS trail FROM x),
elf AS (
  SELECT user_id, idx, n, -1 AS lead, -1 AS trail, 0::BIGINT AS bits FROM y WHERE idx = 0
  UNION ALL
  SELECT user_id, i, n, CASE WHEN x = 0 THEN l0 ELSE l END, CASE WHEN x = 0 OR again THEN t0 ELSE t END, bits + CASE WHEN marked THEN 5 ELSE 1 END + CASE WHEN x = 0 THEN 2 WHEN again THEN 66 - l0 - t0 WHEN 64 - l - t <= 16 THEN 72 - l - t ELSE 74 - l - t END
  FROM (SELECT y.user_id, y.idx AS i, y.n, y.x, y.marked, y.lead AS l, y.trail AS t, elf.lead AS l0, elf.trail AS t0, elf.bits, elf.lead = y.lead AND y.trail >= elf.trail AS again FROM elf JOIN y ON y.user_id = elf.user_id AND y.idx = elf.idx + 1)
),
a AS (
  SELECT user_id, {int(M.Uncompressed)} AS method, 8 * count(*) + 1 AS bytes FROM pts GROUP BY user_id
  UNION ALL SELECT user_id, {int(M.RunLengthEncoding)}, bytes FROM runs
  UNION ALL SELECT user_id, {int(M.Chimp64)}, bytes FROM c
  UNION ALL SELECT user_id, {int(M.Chimp128)}, bytes FROM g
  UNION ALL SELECT user_id, {int(M.BitPackedDeltaEncoding)}, bytes FROM delta
  UNION ALL SELECT user_id, {int(M.Elf)}, 9 + ceil((bits + 12) / 8) FROM elf WHERE idx = n - 1
), sized AS (SELECT a.user_id, a.method, c.n, CASE WHEN c.n = 1 THEN 9 ELSE a.bytes END::BIGINT AS bytes FROM a JOIN (SELECT user_id, count(*) AS n FROM pts GROUP BY user_id) c ON c.user_id = a.user_id)"""


LOSSLESS_BYTES_SQL = f"{lossless_sql()} SELECT *, TRUE AS same FROM sized"
BEST_METHOD_SQL = f"{lossless_sql()} SELECT user_id, min(bytes) AS bytes, arg_min(method, bytes * 100 + method)::INT AS method FROM sized GROUP BY user_id"

def _chords_sql() -> str:
    """Chords extended while their root mean square error is within the bound, from running sums."""
    k, y = "(i - s)", "(v - vs)"
    error = f"sqrt(greatest(q + {y} * {y} - 2 * {y} / {k} * (m + {k} * {y}) + {y} * {y} / ({k} * {k}) * ({k} * ({k} + 1) * (2 * {k} + 1) / 6.0), 0) / ({k} + 1))"
    return f"""WITH RECURSIVE {PTS}, r AS (
  SELECT user_id, idx, value, 0::BIGINT AS s, value AS vs, 0.0::DOUBLE AS q, 0.0::DOUBLE AS m FROM pts WHERE idx = 0
  UNION ALL
  SELECT user_id, i, v, CASE WHEN cut THEN i ELSE s END, CASE WHEN cut THEN v ELSE vs END, CASE WHEN cut THEN 0.0 ELSE q + {y} * {y} END, CASE WHEN cut THEN 0.0 ELSE m + {k} * {y} END
  FROM (SELECT *, {k} > 1 AND {error} > {BOUND} AS cut FROM (SELECT r.*, p.idx AS i, p.value AS v FROM r JOIN pts p ON p.user_id = r.user_id AND p.idx = r.idx + 1))
) SELECT user_id, idx, round(vs + CASE WHEN n > 1 THEN (stop - vs) / (n - 1) * (idx - s) ELSE 0 END + {OFF_TIES}, 4) + 0.0 AS value
FROM (SELECT *, last_value(value) OVER w AS stop, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY user_id, s ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


#: A value within the bound of the one stored last repeats it; others are stored with shortened mantissas.
MACAQUE_V_SQL = f"""WITH RECURSIVE h AS ({base.SHORTENED_SQL}), {PTS}, x AS (SELECT p.user_id, p.idx, p.value, h.value AS short FROM pts p JOIN h USING (user_id, idx)), r AS (
  SELECT user_id, idx, short AS held FROM x WHERE idx = 0
  UNION ALL
  SELECT x.user_id, x.idx, CASE WHEN abs(x.value - held) <= {BOUND} THEN held ELSE short END FROM r JOIN x ON x.user_id = r.user_id AND x.idx = r.idx + 1
) SELECT user_id, idx, round(held + {OFF_TIES}, 4) + 0.0 AS value FROM r"""

#: One point is removed a step, that of the least area, while it is under the bound.
_AREA = "abs(l[k - 1].i * (l[k].v - l[k + 1].v) + l[k].i * (l[k + 1].v - l[k - 1].v) + l[k + 1].i * (l[k - 1].v - l[k].v)) / 2.0"
VISVALINGAM_SQL = f"""WITH RECURSIVE {PTS}, z AS (
  SELECT user_id, 0 AS step, list({{'i': idx, 'v': value}} ORDER BY idx) AS l FROM pts GROUP BY user_id
  UNION ALL
  SELECT user_id, step + 1, list_filter(l, lambda x: x.i <> least.i)
  FROM (SELECT *, list_min(list_transform(range(2, len(l)), lambda k: {{'a': {_AREA}, 'i': l[k].i}})) AS least FROM z) WHERE least.a < {base._VALUES["area_under_curve_error"]}
), k AS (SELECT user_id, unnest(l) AS p FROM z QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY step DESC) = 1),
w AS (SELECT user_id, p.i AS i, p.v AS v, lead(p.i) OVER o AS j, lead(p.v) OVER o AS u FROM k WINDOW o AS (PARTITION BY user_id ORDER BY p.i))
SELECT q.user_id, q.idx, round(CASE WHEN q.idx = w.i THEN v ELSE v + (u - v) * (q.idx - w.i) / (j - w.i) END + {OFF_TIES}, 4) + 0.0 AS value
FROM pts q JOIN w ON w.user_id = q.user_id AND q.idx >= w.i AND (q.idx < w.j OR w.j IS NULL)"""

#: Neighbouring chords are merged, the pair of least error first, while it is within the bound and more than two are left.
_CHORD = "sqrt(list_sum(list_transform(range(a.f, b.t + 1), lambda i: pow(v[a.f + 1] + (v[b.t + 1] - v[a.f + 1]) / (b.t - a.f) * (i - a.f) - v[i + 1], 2))) / (b.t - a.f + 1))"
BOTTOM_UP_SQL = f"""WITH RECURSIVE {PTS}, z AS (
  SELECT user_id, 0 AS step, v, list_transform(range(0, len(v), 2), lambda i: {{'f': i, 't': least(i + 1, len(v) - 1)}}) AS l FROM (SELECT user_id, list(value ORDER BY idx) AS v FROM pts GROUP BY user_id)
  UNION ALL
  SELECT user_id, step + 1, v, list_filter(list_transform(range(1, len(l) + 1), lambda k: CASE WHEN k = least.k THEN {{'f': l[k].f, 't': l[k + 1].t}} ELSE l[k] END), lambda x, k: k <> least.k + 1)
  FROM (SELECT *, list_min(list_transform(range(1, len(l)), lambda k: {{'e': {_CHORD.replace("a.f", "l[k].f").replace("b.t", "l[k + 1].t")}, 'k': k}})) AS least FROM z) WHERE len(l) > 2 AND least.e <= {BOUND}
), k AS (SELECT user_id, v, unnest(l) AS p FROM z QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY step DESC) = 1)
SELECT q.user_id, q.idx, round(v[p.f + 1] + CASE WHEN p.t > p.f THEN (v[p.t + 1] - v[p.f + 1]) / (p.t - p.f) * (q.idx - p.f) ELSE 0 END + {OFF_TIES}, 4) + 0.0 AS value
FROM pts q JOIN k ON k.user_id = q.user_id AND q.idx BETWEEN p.f AND p.t"""

#: Each new point is a group of its own; if there are too many, the two neighbours of the least span together become one.
_SPAN = "(greatest(m[k].hi, m[k + 1].hi) - least(m[k].lo, m[k + 1].lo)) / 2"
HISTOGRAM_SQL = f"""WITH RECURSIVE {PTS}, z AS (
  SELECT user_id, idx, [{{'f': 0::BIGINT, 't': 0::BIGINT, 'lo': value, 'hi': value}}] AS l FROM pts WHERE idx = 0
  UNION ALL
  SELECT user_id, i, CASE WHEN len(m) <= {base.BINS} THEN m ELSE list_filter(list_transform(range(1, len(m) + 1), lambda k: CASE WHEN k = best.k THEN {{'f': m[k].f, 't': m[k + 1].t, 'lo': least(m[k].lo, m[k + 1].lo), 'hi': greatest(m[k].hi, m[k + 1].hi)}} ELSE m[k] END), lambda x, k: k <> best.k + 1) END
  FROM (SELECT *, list_min(list_transform(range(1, len(m)), lambda k: {{'c': {_SPAN}, 'k': k}})) AS best
        FROM (SELECT z.user_id, p.idx AS i, list_append(z.l, {{'f': p.idx, 't': p.idx, 'lo': p.value, 'hi': p.value}}) AS m FROM z JOIN pts p ON p.user_id = z.user_id AND p.idx = z.idx + 1))
), g AS (SELECT user_id, unnest(l) AS p FROM z QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY idx DESC) = 1)
SELECT q.user_id, q.idx, round((p.lo + p.hi) / 2 + {OFF_TIES}, 4) + 0.0 AS value FROM pts q JOIN g ON g.user_id = q.user_id AND q.idx BETWEEN p.f AND p.t"""

QUERIES = {
    "values_PiecewiseConstantHistogram": partial(piece_values, method=M.PiecewiseConstantHistogram),
    "values_VisvalingamWhyatt": partial(piece_values, method=M.VisvalingamWhyatt),
    "values_BottomUp": partial(piece_values, method=M.BottomUp),
    "values_SlidingWindow": partial(piece_values, method=M.SlidingWindow),
    "values_MacaqueV": partial(piece_values, method=M.MacaqueV),
    "lossless_bytes": lossless_bytes,
    "zone_maps_Chimp128": partial(zone_maps, method=M.Chimp128),
    "zone_maps_Midrange": partial(zone_maps, method=M.PoorMansCompressionMidrange),
    "value_filter_Chimp128": partial(value_filter, method=M.Chimp128),
    "value_filter_Midrange": partial(value_filter, method=M.PoorMansCompressionMidrange),
    "source_points": source_points,
    "sql_round_trip": sql_round_trip,
    "long_spectrum": long_spectrum,
    "dft_reconstruct": dft_reconstruct,
    "dft_points": dft_points,
    "dft_sums": dft_sums,
    "values_SimPiece": partial(piece_values, method=M.SimPiece),
    "values_MixPiece": partial(piece_values, method=M.MixPiece),
    "piece_points_SimPiece": partial(piece_points, method=M.SimPiece),
    "piece_points_MixPiece": partial(piece_points, method=M.MixPiece),
    "piece_sums_SimPiece": partial(piece_sums, method=M.SimPiece),
    "piece_sums_MixPiece": partial(piece_sums, method=M.MixPiece),
    "long_segments": long_segments,
    "stream_runs": partial(streamed, method=M.RunLengthEncoding, bound=0.0),
    "stream_swing": partial(streamed, method=M.SwingFilterDisconnected, bound=BOUND),
    "interval_points": interval_points,
    "interval_sums": interval_sums,
    "asof_views": asof_views,
    "aligned_kinds": aligned_kinds,
}
ORACLE_SQL = {
    "values_PiecewiseConstantHistogram": HISTOGRAM_SQL,
    "values_VisvalingamWhyatt": VISVALINGAM_SQL,
    "values_BottomUp": BOTTOM_UP_SQL,
    "values_SlidingWindow": _chords_sql(),
    "values_MacaqueV": MACAQUE_V_SQL,
    "lossless_bytes": LOSSLESS_BYTES_SQL,
    "best_method": BEST_METHOD_SQL,
    "zone_maps_Chimp128": _zones_sql(PTS),
    "zone_maps_Midrange": _zones_sql(_CHUNKED).replace("WITH", "WITH RECURSIVE", 1),
    "value_filter_Chimp128": _filter_sql(PTS),
    "value_filter_Midrange": _filter_sql(_CHUNKED).replace("WITH", "WITH RECURSIVE", 1),
    "source_points": SOURCE_POINTS_SQL,
    "sql_round_trip": SQL_ROUND_TRIP_SQL,
    "long_spectrum": LONG_SPECTRUM_SQL,
    "dft_reconstruct": DFT_RECONSTRUCT_SQL,
    "dft_points": DFT_POINTS_SQL,
    "dft_sums": DFT_SUMS_SQL,
    "values_SimPiece": _piece_values_sql(False),
    "values_MixPiece": _piece_values_sql(True),
    "piece_points_SimPiece": _piece_points_sql(False),
    "piece_points_MixPiece": _piece_points_sql(True),
    "piece_sums_SimPiece": _piece_sums_sql(False),
    "piece_sums_MixPiece": _piece_sums_sql(True),
    "long_segments": LONG_SEGMENTS_SQL,
    "stream_runs": STREAM_RUNS_SQL,
    "stream_swing": STREAM_SWING_SQL,
    "interval_points": INTERVAL_POINTS_SQL,
    "interval_sums": INTERVAL_SUMS_SQL,
    "asof_views": ASOF_VIEWS_SQL,
    "aligned_kinds": ALIGNED_KINDS_SQL,
}
