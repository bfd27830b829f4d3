"""The registered queries of the series operators and their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import udfs
from .kernels.segments import margin
from .kernels.values import bucket
from .methods import FIELDS, Method, bound32
from .operators import series
from .plans import fourier, native
from .sources.tables import read_points

M = Method
KEY = ["user_id"]
#: The configuration of each query: bound in value units, bins, points, terms and decimal places.
BOUND, BINS, POINTS, TERMS, PLACES = 5.0, 12, 20, 9, 4
_VALUES = {"abs_error_bound": BOUND, "histogram_bins_number": BINS, "target_point_count": POINTS, "number_of_coefficients": TERMS, "decimal_precision": PLACES, "aggregate_error_type": "rmse", "aggregate_error_bound": BOUND, "area_under_curve_error": 20.0}
LOSSLESS = [M.Uncompressed, M.RunLengthEncoding, M.Chimp64, M.Chimp128, M.BitPackedDeltaEncoding, M.Elf]
ZERO_BOUND = [M.PoorMansCompressionMidrange, M.PoorMansCompressionMean, M.SwingFilter, M.SwingFilterDisconnected, M.SlideFilter, M.ABCLinearApproximation, M.BitPackedQuantization, M.SerfQT, M.MacaqueS, M.MacaqueV]
BOUNDED = [m for m, f in FIELDS.items() if "abs_error_bound" in f]
SIZED = {M.PiecewiseConstantHistogram: BINS, M.PiecewiseLinearHistogram: BINS, M.LargestTriangleThreeBuckets: POINTS - 1, M.DiscreteFourierTransform: TERMS + 1}
MODELS = [m for m in M if m not in series.codec.BIT_STREAMS]

PTS = "pts AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value FROM events)"


def config(method: Method, **changes) -> dict:
    return {k: changes.get(k, _VALUES[k]) for k in FIELDS.get(method, {})}


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_points(spark, sf_dir, "events")


def payloads(spark: SparkSession, sf_dir: str, method: Method, **changes) -> DataFrame:
    return series.compress(series.pack(points(spark, sf_dir), KEY), method, config(method, **changes))


def round_trip(spark: SparkSession, sf_dir: str, method: Method, **changes) -> DataFrame:
    return series.unpack(series.decompress(payloads(spark, sf_dir, method, **changes)), KEY)


ROUND_TRIP_SQL = f"WITH {PTS} SELECT user_id, idx, value FROM pts"


def _gap(pairs: DataFrame, bound: float) -> DataFrame:
    """user_id, n, n_decoded, within_bound of rows with values and decoded arrays."""
    worst = F.aggregate(F.zip_with("values", "decoded", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, b: F.greatest(a, b))
    return pairs.select("user_id", F.size("values").cast("long").alias("n"), F.size("decoded").cast("long").alias("n_decoded"), (worst <= F.lit(bound * (1 + 1e-9))).alias("within_bound"))


def bounded(spark: SparkSession, sf_dir: str, method: Method, bound: float | None = None) -> DataFrame:
    """Per series: lengths, and whether each decoded value is within the bound. The raw array rides along, so there is no join."""
    packed = series.pack(points(spark, sf_dir), KEY).withColumn("raw", F.col("values"))
    decoded = series.decompress(series.compress(packed, method, config(method)))
    return _gap(decoded.select("user_id", F.col("raw").alias("values"), F.col("values").alias("decoded")), bound32(BOUND) if bound is None else bound)


BOUNDED_SQL = "SELECT user_id, count(*) AS n, count(*) AS n_decoded, TRUE AS within_bound FROM events GROUP BY user_id"


def sized(spark: SparkSession, sf_dir: str, method: Method, most: int | None) -> DataFrame:
    """Per series: lengths, and whether the model is no larger than asked for."""
    both = series.decompress(series.extract(payloads(spark, sf_dir, method), keep=True))
    small = F.size("indices") <= (F.lit(most) if most is not None else F.col("n"))
    return both.select("user_id", "n", F.size("values").cast("long").alias("n_decoded"), small.alias("within_size"))


SIZED_SQL = "SELECT user_id, count(*) AS n, count(*) AS n_decoded, TRUE AS within_size FROM events GROUP BY user_id"


def extract_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether extract and rebuild give back the same payload, for each method that has them; the series are packed once for all."""
    rows = series.compress_each(series.pack(points(spark, sf_dir), KEY), {m: config(m) for m in MODELS})
    out = series.rebuild(series.extract(rows, keep=True), into="rebuilt")
    name = F.create_map(*(F.lit(x) for m in MODELS for x in (int(m), m.name)))[F.col("method").cast("int")]
    return out.select("user_id", name.alias("method"), (F.col("rebuilt") == F.col("payload")).alias("same"))


EXTRACT_REBUILD_SQL = "SELECT user_id, method, TRUE AS same FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest([%s]) AS method)" % ", ".join(f"'{m.name}'" for m in MODELS)


def run_length_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.runs(points(spark, sf_dir), KEY).select("user_id", "seg", "start_idx", "end_idx", F.col("c0").alias("value"))


RUNS_SQL = f"""WITH {PTS}, m AS (
  SELECT *, CASE WHEN lag(value) OVER w IS NULL OR lag(value) OVER w <> value THEN 1 ELSE 0 END AS new FROM pts WINDOW w AS (PARTITION BY user_id ORDER BY idx)
), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY idx) - 1 AS seg FROM m)
SELECT user_id, seg::BIGINT AS seg, min(idx) AS start_idx, max(idx) + 1 AS end_idx, min(value) AS value FROM s GROUP BY user_id, seg"""


def midrange_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _midrange_table(spark, sf_dir)
    return table.select("user_id", "seg", "start_idx", "end_idx", F.round("c0", 6).alias("value"))


_MIDRANGE = f"""{PTS}, r AS (
  SELECT user_id, idx, value, value AS lo, value AS hi, 0 AS seg FROM pts WHERE idx = 0
  UNION ALL
  SELECT p.user_id, p.idx, p.value, CASE WHEN cut THEN p.value ELSE least(lo, p.value) END, CASE WHEN cut THEN p.value ELSE greatest(hi, p.value) END, seg + cut::INT
  FROM (SELECT r.*, p.idx AS i, greatest(r.hi, p.value) - least(r.lo, p.value) > {2 * BOUND} AS cut FROM r JOIN pts p ON p.user_id = r.user_id AND p.idx = r.idx + 1) q
  JOIN pts p ON p.user_id = q.user_id AND p.idx = q.i
), s AS (SELECT user_id, seg, min(idx) AS start_idx, max(idx) + 1 AS end_idx, (min(value) + max(value)) / 2 AS value FROM r GROUP BY user_id, seg)"""
MIDRANGE_SQL = f"WITH RECURSIVE {_MIDRANGE} SELECT user_id, seg::BIGINT AS seg, start_idx, end_idx, round(value, 6) AS value FROM s"


def _midrange_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.segments(payloads(spark, sf_dir, M.PoorMansCompressionMidrange), KEY, M.PoorMansCompressionMidrange)


def segment_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = native.aggregate(_midrange_table(spark, sf_dir), KEY)
    return out.select("user_id", "n", *(F.round(c, 4).alias(c) for c in ("total", "least", "most")))


SEGMENT_AGGREGATE_SQL = f"""WITH RECURSIVE {_MIDRANGE}
SELECT user_id, sum(end_idx - start_idx)::BIGINT AS n, round(sum(value * (end_idx - start_idx)), 4) AS total, round(min(value), 4) AS least, round(max(value), 4) AS most FROM s GROUP BY user_id"""


def segment_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = native.decode(_midrange_table(spark, sf_dir), KEY, 10, 30)
    return out.select("user_id", "idx", F.round("value", 6).alias("value"))


SEGMENT_RANGE_SQL = f"""WITH RECURSIVE {_MIDRANGE}
SELECT r.user_id, r.idx, round(s.value, 6) AS value FROM r JOIN s ON r.user_id = s.user_id AND r.seg = s.seg WHERE r.idx >= 10 AND r.idx < 30"""


def quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.quantized(points(spark, sf_dir), KEY, BOUND).withColumn("decoded", F.round("decoded", 6))


_STEP = repr(bucket(BOUND))
QUANTIZED_SQL = f"""WITH {PTS}, q AS (SELECT user_id, idx, min(value) OVER (PARTITION BY user_id) AS least, value FROM pts),
c AS (SELECT *, round((value - least) / {_STEP}::DOUBLE)::BIGINT AS q FROM q)
SELECT user_id, idx, q, round(least + q * {_STEP}::DOUBLE, 6) AS decoded, (CASE WHEN q < 256 THEN 10 WHEN q < 65536 THEN 18 ELSE 34 END)::BIGINT AS bits FROM c"""


def quantization_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    decoded = round_trip(spark, sf_dir, M.BitPackedQuantization)
    out = series.evaluate(p, decoded, KEY, bound32(BOUND))
    return out.select("user_id", "n", "n_decoded", F.round("max_abs_err", 6).alias("max_abs_err"), F.round("rmse", 6).alias("rmse"), "within_bound")


QUANTIZATION_ERROR_SQL = f"""WITH {PTS}, q AS (SELECT user_id, min(value) OVER (PARTITION BY user_id) AS least, value FROM pts),
c AS (SELECT user_id, abs(least + round((value - least) / {_STEP}::DOUBLE) * {_STEP}::DOUBLE - value) AS e FROM q)
SELECT user_id, count(*) AS n, count(*) AS n_decoded, round(max(e), 6) AS max_abs_err, round(sqrt(avg(e * e)), 6) AS rmse, max(e) <= {BOUND} AS within_bound FROM c GROUP BY user_id"""


def fixed_point_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel and native plan of the bounded fixed-point method side by side; they must be one."""
    decoded = round_trip(spark, sf_dir, M.BitPackedBUFF)
    plan = points(spark, sf_dir).withColumn("planned", native.fixed_point(F.col("value"), PLACES)).drop("value")
    out = decoded.join(plan, ["user_id", "idx"])
    return out.select("user_id", "idx", F.round("value", 9).alias("value"), (F.col("value") == F.col("planned")).alias("same"))


FIXED_POINT_SQL = f"WITH {PTS} SELECT user_id, idx, round(floor(value) + floor((value - floor(value)) * 32768) / 32768, 9) AS value, TRUE AS same FROM pts"


def shortened_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = round_trip(spark, sf_dir, M.MacaqueS)
    plan = points(spark, sf_dir).withColumn("planned", native.shortened(F.col("value"), BOUND)).drop("value")
    out = decoded.join(plan, ["user_id", "idx"])
    return out.select("user_id", "idx", "value", (F.col("value") == F.col("planned")).alias("same"))


SHORTENED_SQL = f"""WITH {PTS}, e AS (SELECT *, CASE WHEN value = 0 THEN 0 ELSE floor(log2(abs(value))) END AS p FROM pts),
k AS (SELECT *, greatest(floor(-log2({BOUND} / pow(2.0, p))), 0) AS b FROM e),
c AS (SELECT *, trunc(value / pow(2.0, p - b)) * pow(2.0, p - b) AS v0, trunc(value / pow(2.0, p - b - 1)) * pow(2.0, p - b - 1) AS v1 FROM k)
SELECT user_id, idx, CASE WHEN value = 0 THEN value WHEN abs(v0 - value) <= {BOUND} THEN v0 ELSE v1 END AS value, TRUE AS same FROM c"""


def closed_loop_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, sf_dir, M.SerfQT).withColumn("value", F.round("value", 6))


CLOSED_LOOP_SQL = f"""WITH RECURSIVE {PTS}, r AS (
  SELECT user_id, idx, round(value / {_STEP}::DOUBLE) * {_STEP}::DOUBLE AS p FROM pts WHERE idx = 0
  UNION ALL
  SELECT x.user_id, x.idx, p + round((x.value - p) / {_STEP}::DOUBLE) * {_STEP}::DOUBLE FROM r JOIN pts x ON x.user_id = r.user_id AND x.idx = r.idx + 1
) SELECT user_id, idx, round(p, 6) AS value FROM r"""


def decoded_values(spark: SparkSession, sf_dir: str, method: Method, places: int = 4) -> DataFrame:
    """Each decoded value at the bound, size or count of the method."""
    return round_trip(spark, sf_dir, method).withColumn("value", F.round("value", places) + 0.0)


MEAN_VALUES_SQL = f"""WITH RECURSIVE {PTS}, r AS (
  SELECT user_id, idx, value, value AS lo, value AS hi, value AS total, 1 AS n, 0 AS seg FROM pts WHERE idx = 0
  UNION ALL
  SELECT user_id, i, v, CASE WHEN cut THEN v ELSE least(lo, v) END, CASE WHEN cut THEN v ELSE greatest(hi, v) END, CASE WHEN cut THEN v ELSE total + v END, CASE WHEN cut THEN 1 ELSE n + 1 END, seg + cut::INT
  FROM (SELECT r.*, p.idx AS i, p.value AS v, greatest(hi, p.value) - (total + p.value) / (n + 1) > {BOUND} OR (total + p.value) / (n + 1) - least(lo, p.value) > {BOUND} AS cut
        FROM r JOIN pts p ON p.user_id = r.user_id AND p.idx = r.idx + 1)
) SELECT user_id, idx, round(avg(value) OVER (PARTITION BY user_id, seg), 4) + 0.0 AS value FROM r"""


def _swing_sql(connected: bool) -> str:
    """Cones of slopes point by point; a cone that is left ends on its best slope within the cone."""
    eb, inf = f"{margin(BOUND)!r}::DOUBLE", "'infinity'::DOUBLE"
    stop = "CASE WHEN idx - s > 1 THEN vs + least(greatest(mom / ((idx - s) * (idx - s + 1) * (2 * (idx - s) + 1) / 6), down), up) * (idx - s) ELSE value END"
    if connected:
        fresh = ("idx", "stop", f"v + {eb} - stop", f"v - {eb} - stop", "v - stop")
    else:
        fresh = ("i", "v", inf, f"-{inf}", "0.0")
    on = ("s", "vs", f"least(up, (v + {eb} - vs) / (i - s))", f"greatest(down, (v - {eb} - vs) / (i - s))", "mom + (v - vs) * (i - s)")
    steps = ", ".join(f"CASE WHEN cut THEN {a} ELSE {b} END" for a, b in zip(fresh, on))
    return f"""WITH RECURSIVE {PTS}, r AS (
  SELECT user_id, idx, value, 0::BIGINT AS s, value AS vs, {inf} AS up, -{inf} AS down, 0.0::DOUBLE AS mom, 0 AS seg FROM pts WHERE idx = 0
  UNION ALL
  SELECT user_id, i, v, {steps}, seg + cut::INT
  FROM (SELECT r.*, p.idx AS i, p.value AS v, r.idx > s AND NOT (down * (p.idx - s) + vs - {eb} <= p.value AND p.value <= up * (p.idx - s) + vs + {eb}) AS cut, {stop.replace("value", "r.value").replace("idx", "r.idx")} AS stop
        FROM r JOIN pts p ON p.user_id = r.user_id AND p.idx = r.idx + 1)
), e AS (
  SELECT user_id, seg, idx AS last, {stop} AS stop FROM r QUALIFY row_number() OVER (PARTITION BY user_id, seg ORDER BY idx DESC) = 1
) SELECT r.user_id, r.idx, round(CASE WHEN last = s THEN vs ELSE vs + (stop - vs) * (r.idx - s) / (last - s) END, 4) + 0.0 AS value FROM r JOIN e ON e.user_id = r.user_id AND e.seg = r.seg"""


#: Buckets as in bucket_means; each keeps the point of the largest triangle with the point kept before and the mean of the next bucket.
LTTB_SQL = f"""WITH RECURSIVE {PTS}, c AS (SELECT user_id, count(*) AS n, count(*) - 2 AS m FROM pts GROUP BY user_id),
g AS (SELECT user_id, n, b, 1 + (b * m) // {POINTS - 2} AS lo, 1 + ((b + 1) * m) // {POINTS - 2} AS hi, CASE WHEN b + 2 <= {POINTS - 2} THEN least(1 + ((b + 2) * m) // {POINTS - 2}, n) ELSE n END AS stop FROM c, range({POINTS - 2}) t(b) WHERE n > {POINTS}),
x AS (SELECT g.user_id, b, lo, hi, (hi + stop) // 2 AS x3, avg(p.value) AS y3 FROM g JOIN pts p ON p.user_id = g.user_id AND p.idx >= hi AND p.idx < stop GROUP BY ALL),
t AS (SELECT x.user_id, b, x3, y3, p.idx AS i, p.value AS v FROM x JOIN pts p ON p.user_id = x.user_id AND p.idx >= lo AND p.idx < hi),
k AS (
  SELECT user_id, -1::BIGINT AS b, idx AS i, value AS v FROM pts WHERE idx = 0
  UNION ALL
  SELECT user_id, b, i, v FROM (
    SELECT t.user_id, t.b, t.i, t.v, row_number() OVER (PARTITION BY t.user_id ORDER BY abs(k.i * (t.v - y3) + t.i * (y3 - k.v) + x3 * (k.v - t.v)) DESC, t.i) AS r
    FROM k JOIN t ON t.user_id = k.user_id AND t.b = k.b + 1) WHERE r = 1
), f AS (SELECT user_id, i, v FROM k UNION SELECT p.user_id, idx, value FROM pts p JOIN c ON c.user_id = p.user_id WHERE idx = n - 1 OR n <= {POINTS}),
w AS (SELECT user_id, i, v, lead(i) OVER o AS j, lead(v) OVER o AS u FROM f WINDOW o AS (PARTITION BY user_id ORDER BY i))
SELECT p.user_id, p.idx, round(CASE WHEN p.idx = w.i THEN v ELSE v + (u - v) * (p.idx - w.i) / (j - w.i) END, 7) + 0.0 AS value
FROM pts p JOIN w ON w.user_id = p.user_id AND p.idx >= w.i AND (p.idx < w.j OR w.j IS NULL)"""


def discounted_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per supplier: how many discounted prices are nearly the same by two orders of operations."""
    price, off = F.col("l_extendedprice").cast("double"), F.col("l_discount").cast("double")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", series.nearly_equal(price * (1 - off), price - price * off).alias("near"))
    return rows.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if("near").alias("n_near"))


DISCOUNTED_SQL = f"""WITH d AS (SELECT l_suppkey, l_extendedprice::DOUBLE * (1 - l_discount::DOUBLE) AS a, l_extendedprice::DOUBLE - l_extendedprice::DOUBLE * l_discount::DOUBLE AS b FROM lineitem)
SELECT l_suppkey, count(*) AS n, count(*) FILTER (abs(a - b) <= {series.ABS_TOLERANCE!r} OR abs(a - b) <= greatest(abs(a), abs(b)) * {series.REL_TOLERANCE!r}) AS n_near FROM d GROUP BY l_suppkey"""


def scaled_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.scaled_deltas(points(spark, sf_dir), KEY, 100)


DELTAS_SQL = f"""WITH {PTS}, x AS (SELECT user_id, idx, round(value * 100)::BIGINT AS x FROM pts),
d AS (SELECT user_id, idx, x - lag(x) OVER (PARTITION BY user_id ORDER BY idx) AS d FROM x),
e AS (SELECT user_id, idx, d - min(d) OVER (PARTITION BY user_id) AS delta FROM d)
SELECT user_id, idx, delta, (CASE WHEN delta < 256 THEN 10 WHEN delta < 65536 THEN 18 ELSE 34 END)::BIGINT AS bits FROM e WHERE delta IS NOT NULL"""


def first_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.first_areas(points(spark, sf_dir), KEY).withColumn("area", F.round("area", 6))


AREAS_SQL = f"""WITH {PTS}, w AS (SELECT user_id, idx, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM pts WINDOW w AS (PARTITION BY user_id ORDER BY idx))
SELECT user_id, idx, round(abs(a - 2 * value + b) / 2, 6) AS area FROM w WHERE a IS NOT NULL AND b IS NOT NULL"""


def bucket_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.bucket_means(points(spark, sf_dir), KEY, POINTS).withColumn("mean", F.round("mean", 6))


BUCKETS_SQL = f"""WITH {PTS}, c AS (SELECT user_id, count(*) - 2 AS m FROM pts GROUP BY user_id),
b AS (SELECT user_id, b, 1 + (b * m) // {POINTS - 2} AS lo, 1 + ((b + 1) * m) // {POINTS - 2} AS hi FROM c, range({POINTS - 2}) t(b))
SELECT b.user_id, b.b AS bucket, count(*) AS n, round(avg(value), 6) AS mean FROM b JOIN pts p ON p.user_id = b.user_id AND p.idx >= lo AND p.idx < hi GROUP BY ALL"""


def fourier_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of the plan, and whether the kernel kept the same frequencies."""
    found = fourier.strongest(fourier.terms(points(spark, sf_dir), KEY), KEY, TERMS)
    kept = series.extract(payloads(spark, sf_dir, M.DiscreteFourierTransform)).select("user_id", F.slice("indices", 3, TERMS).alias("ks"))
    return found.join(kept, "user_id").select("user_id", "k", (F.round("re", 4) + 0.0).alias("re"), (F.round("im", 4) + 0.0).alias("im"), ((F.col("k") == 0) | F.array_contains("ks", F.col("k"))).alias("same"))


FOURIER_SQL = f"""WITH {PTS}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM pts),
t AS (SELECT user_id, k, sum(value * cos(2 * pi() * k * idx / n)) AS re, -sum(value * sin(2 * pi() * k * idx / n)) AS im FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM n) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (k > 0)::INT, round(re * re + im * im, 4) DESC, k) AS r FROM t)
SELECT user_id, k, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im, TRUE AS same FROM o WHERE r <= {TERMS}"""


def payload_bytes(spark: SparkSession, sf_dir: str, methods=M) -> DataFrame:
    """Bytes and ratio of each method on each series; one pass over the packed series serves all methods."""
    rows = series.compress_each(series.pack(points(spark, sf_dir), KEY), {m: config(m) for m in methods})
    out = rows.select("user_id", F.col("method").cast("int").alias("method"), "n", F.octet_length("payload").cast("long").alias("bytes"))
    return out.withColumn("ratio", F.round(F.col("n") * 8 / F.col("bytes"), 4))


def best_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest lossless payload of each series."""
    rows = payload_bytes(spark, sf_dir, LOSSLESS)
    return rows.groupBy("user_id").agg(F.min(F.struct("bytes", "method")).alias("b")).select("user_id", "b.bytes", "b.method")


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verbs as SQL functions."""
    udfs.register(spark)
    view = "loomline_packed"
    series.pack(points(spark, sf_dir), KEY).createOrReplaceTempView(view)
    return spark.sql(f"""SELECT user_id, CAST(size(values) AS BIGINT) AS n, ts_decompress(ts_compress(values, 'Elf', '{{}}')) = values AS elf_same,
      size(ts_extract(ts_compress(values, 'SwingFilter', '{{"abs_error_bound": 0.0}}')).coefficients) > 1 AS has_model FROM {view}""")


SQL_FUNCTIONS_SQL = "SELECT user_id, count(*) AS n, TRUE AS elf_same, TRUE AS has_model FROM events GROUP BY user_id"


def quantity_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of l_quantity by supplier, decoded and summed: the large series of the tables."""
    p = read_points(spark, sf_dir, "lineitem")
    return native.aggregate(native.runs(p, ["l_suppkey"]), ["l_suppkey"]).select("l_suppkey", "n", F.round("total", 2).alias("total"), "least", "most")


QUANTITY_RUNS_SQL = "SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS total, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY l_suppkey"


def embedding_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed input as it is: each embedding is a series."""
    packed = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("values"))
    back = series.decompress(series.compress(packed, M.Chimp128, {}))
    return back.select("vec_id", F.posexplode("values").alias("pos", "value")).select("vec_id", F.col("pos").cast("long").alias("pos"), "value")


EMBEDDING_SQL = "SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings"


def region_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed order series joined with their dimensions: segments per region."""
    p = read_points(spark, sf_dir, "orders")
    runs = native.runs(p, ["o_custkey"])
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey")
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    per = runs.groupBy("o_custkey").agg(F.count("*").alias("segments"), F.sum(F.col("end_idx") - F.col("start_idx")).alias("n"))
    rows = per.join(customer, per["o_custkey"] == customer["c_custkey"]).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(F.sum("segments").alias("segments"), F.sum("n").alias("n"))


REGION_SQL = """WITH p AS (SELECT o_custkey, o_totalprice AS v, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS u FROM orders)
SELECT r_name, count(*) FILTER (u IS NULL OR u <> v)::BIGINT AS segments, count(*)::BIGINT AS n FROM p JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per series: points, segments, largest error and whether the bound holds, through the segment table."""
    packed = series.pack(points(spark, sf_dir), KEY).withColumn("raw", F.col("values"))
    compressed = series.compress(packed, M.PoorMansCompressionMidrange, config(M.PoorMansCompressionMidrange))
    # a series of one value is one segment of that value
    found = series.extract(compressed, permissive=True).select("user_id", "raw", F.coalesce("indices", F.array(F.lit(1).cast("long"))).alias("indices"), F.coalesce("coefficients", "raw").alias("coefficients"))
    table = found.select("user_id", "raw", F.inline(F.transform("indices", lambda e, i: F.struct(e.alias("stop"), F.coalesce(F.get("indices", i - 1), F.lit(0)).alias("start"), F.get("coefficients", i).alias("c")))))
    worst = F.aggregate(F.slice("raw", F.col("start").cast("int") + 1, (F.col("stop") - F.col("start")).cast("int")), F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v - F.col("c"))))
    out = table.withColumn("e", worst).groupBy("user_id").agg(F.max("stop").alias("n"), F.count("*").alias("segments"), F.round(F.max("e"), 6).alias("max_abs_err"))
    return out.withColumn("within_bound", F.col("max_abs_err") <= bound32(BOUND))


FLAGSHIP_SQL = f"""WITH RECURSIVE {_MIDRANGE}
SELECT r.user_id, count(*) AS n, max(r.seg) + 1 AS segments, round(max(abs(r.value - s.value)), 6) AS max_abs_err, round(max(abs(r.value - s.value)), 6) <= {BOUND} AS within_bound
FROM r JOIN s ON r.user_id = s.user_id AND r.seg = s.seg GROUP BY r.user_id"""


def _named() -> tuple[dict, dict]:
    queries, sql = {"flagship_midrange": flagship}, {"flagship_midrange": FLAGSHIP_SQL.replace("max(r.seg) + 1 AS", "(max(r.seg) + 1)::BIGINT AS")}
    for m in LOSSLESS:
        queries[f"round_trip_{m.name}"], sql[f"round_trip_{m.name}"] = partial(round_trip, method=m), ROUND_TRIP_SQL
    for m in ZERO_BOUND:
        queries[f"zero_bound_{m.name}"], sql[f"zero_bound_{m.name}"] = partial(round_trip, method=m, abs_error_bound=0.0), ROUND_TRIP_SQL
    for m in BOUNDED:
        queries[f"bounded_{m.name}"], sql[f"bounded_{m.name}"] = partial(bounded, method=m), BOUNDED_SQL
    queries["bounded_BitPackedBUFF"], sql["bounded_BitPackedBUFF"] = partial(bounded, method=M.BitPackedBUFF, bound=10.0**-PLACES), BOUNDED_SQL
    for m, text in ((M.PoorMansCompressionMean, MEAN_VALUES_SQL), (M.SwingFilter, _swing_sql(True)), (M.SwingFilterDisconnected, _swing_sql(False))):
        queries[f"values_{m.name}"], sql[f"values_{m.name}"] = partial(decoded_values, method=m), text
    # values between points kept have ties at four places
    queries["values_LargestTriangleThreeBuckets"], sql["values_LargestTriangleThreeBuckets"] = partial(decoded_values, method=M.LargestTriangleThreeBuckets, places=7), LTTB_SQL
    for m in (*SIZED, M.VisvalingamWhyatt, M.SlidingWindow, M.BottomUp):
        queries[f"sized_{m.name}"], sql[f"sized_{m.name}"] = partial(sized, method=m, most=SIZED.get(m)), SIZED_SQL
    for name, f, text in (
        ("extract_rebuild", extract_rebuild, EXTRACT_REBUILD_SQL),
        ("run_length_segments", run_length_segments, RUNS_SQL),
        ("midrange_segments", midrange_segments, MIDRANGE_SQL),
        ("segment_aggregate", segment_aggregate, SEGMENT_AGGREGATE_SQL),
        ("segment_range", segment_range, SEGMENT_RANGE_SQL),
        ("quantized_codes", quantized, QUANTIZED_SQL),
        ("quantization_error", quantization_error, QUANTIZATION_ERROR_SQL),
        ("fixed_point_values", fixed_point_values, FIXED_POINT_SQL),
        ("shortened_values", shortened_values, SHORTENED_SQL),
        ("closed_loop_values", closed_loop_values, CLOSED_LOOP_SQL),
        ("scaled_deltas", scaled_deltas, DELTAS_SQL),
        ("first_areas", first_areas, AREAS_SQL),
        ("bucket_means", bucket_means, BUCKETS_SQL),
        ("fourier_terms", fourier_terms, FOURIER_SQL),
        ("payload_bytes", payload_bytes, None),
        ("best_method", best_method, None),
        ("sql_functions", sql_functions, SQL_FUNCTIONS_SQL),
        ("quantity_runs", quantity_runs, QUANTITY_RUNS_SQL),
        ("embedding_round_trip", embedding_round_trip, EMBEDDING_SQL),
        ("region_series", region_series, REGION_SQL),
        ("discounted_near", discounted_near, DISCOUNTED_SQL),
    ):
        queries[name] = f
        if text:
            sql[name] = text
    return queries, sql


QUERIES, ORACLE_SQL = _named()
