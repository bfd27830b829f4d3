"""One-pass segments over a stream of many keys: one open segment a key in the state, timers that close it.

A key's state is one row: where its open segment began, how many steps it has, the last point's place in
order and a few numbers of the method. A point closes the open segment if it does not fit; a timer (a key has one, which is set again if
points have come since) closes it, and forgets the key, once the watermark is ``idle`` past the key's last point, and a point that comes later than
that begins the key anew as well, so the result does not depend on how points fall into micro-batches. Points of a micro-batch are sorted;
a point that comes before the last one of its key, or that the method cannot take (null, not finite), is
refused and counted with the segment that is open then.

Calls between JVM and Python are what a key costs, so keys of one hash are a bucket: their states are a list that is read and written at once,
and one timer stands for those of all its keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..kernels.segments import margin
from ..methods import Method, SeriesError, bound32, method_of

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NUMBERS = 5
_STATE = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "steps", "next", "last_ts", "last_tie", "refused")] + [T.StructField(f"x{i}", T.DoubleType()) for i in range(_NUMBERS)])


class Runs:
    """Equal values."""

    def begin(self, v: float) -> list[float]:
        return [v]

    def add(self, x: list[float], steps: int, v: float) -> list[float] | None:
        return x if v == x[0] else None

    def ends(self, x: list[float], steps: int) -> tuple[float, float]:
        return x[0], x[0]


class Midrange:
    """Values that span no more than twice the bound."""

    def __init__(self, bound: float):
        self.limit = 2 * bound32(bound)

    def begin(self, v: float) -> list[float]:
        return [v, v]

    def add(self, x: list[float], steps: int, v: float) -> list[float] | None:
        x = [min(x[0], v), max(x[1], v)]
        return x if x[1] - x[0] <= self.limit else None

    def ends(self, x: list[float], steps: int) -> tuple[float, float]:
        return (x[0] + x[1]) / 2, (x[0] + x[1]) / 2


class Swing:
    """A cone of slopes from the first value: first value, largest and least slope, moment, last value."""

    def __init__(self, bound: float):
        self.bound = margin(bound)

    def begin(self, v: float) -> list[float]:
        return [v, math.inf, -math.inf, 0.0, v]

    def add(self, x: list[float], steps: int, v: float) -> list[float] | None:
        first, up, down, moment, _ = x
        k, eb = steps + 1, self.bound
        if steps and not down * k + first - eb <= v <= up * k + first + eb:
            return None
        return [first, min(up, (v + eb - first) / k), max(down, (v - eb - first) / k), moment + (v - first) * k, v]

    def ends(self, x: list[float], steps: int) -> tuple[float, float]:
        first, up, down, moment, last = x
        if steps < 2:
            return first, last
        return first, first + min(max(moment / (steps * (steps + 1) * (2 * steps + 1) / 6), down), up) * steps


def _step(method: Method, bound: float):
    if method is Method.RunLengthEncoding:
        return Runs(), False
    if method is Method.PoorMansCompressionMidrange:
        return Midrange(bound), False
    if method in (Method.SwingFilter, Method.SwingFilterDisconnected):
        return Swing(bound), method is Method.SwingFilter
    raise SeriesError("UnsupportedMethod", f"{method.name} is not streamed")


class Segments(StatefulProcessor):
    """``chained``: a segment starts at the end of the one before, at its last value."""

    def __init__(self, step, chained: bool, value: str, idle_ms: int, names: list[str]):
        self.step, self.chained, self.value, self.idle, self.names = step, chained, value, idle_ms, names

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        step, out, row = self.step, [], Row(*self.names)
        held = self.state.get()
        start, steps, nxt, last_ts, last_tie, refused, *x = held if held else (0, -1, 0, None, 0, 0, *[0.0] * _NUMBERS)
        points = sorted(((r["ts"], r["tie"], r[self.value]) for r in rows), key=lambda p: (p[0], p[1] is None, p[1] or 0))
        for ts, tie, v in points:
            if v is None or tie is None or not math.isfinite(v := float(v)) or (last_ts is not None and (ts, tie) <= (last_ts, last_tie)):
                refused += 1
                continue
            if last_ts is not None and ts - last_ts > self.idle * 1000:
                out.append((*key, start, start + steps + 1, *step.ends(x, steps), refused))
                steps, nxt, refused = -1, 0, 0
            grown = step.add(x, steps, v) if steps >= 0 else None
            if grown is not None:
                x, steps = grown, steps + 1
            elif steps < 0:
                start, x, steps = nxt, step.begin(v), 0
            else:
                first, last = step.ends(x, steps)
                out.append((*key, start, start + steps + 1, first, last, refused))
                refused = 0
                if self.chained:
                    start, x, steps = nxt - 1, step.add(step.begin(last), 0, v), 1
                else:
                    start, x, steps = nxt, step.begin(v), 0
            nxt, last_ts, last_tie = nxt + 1, ts, tie
        if last_ts is not None:
            self.state.update((start, steps, nxt, last_ts, last_tie, refused, *x, *[0.0] * (_NUMBERS - len(x))))
            if not held:
                self.handle.registerTimer(last_ts // 1000 + self.idle)
        return (row(*x) for x in out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, out = self.state.get(), []
        if held and (due := held[3] // 1000 + self.idle) > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
        elif held:
            start, steps, _, _, _, refused, *x = held
            out.append(Row(*self.names)(*key, start, start + steps + 1, *self.step.ends(x, steps), refused))
            self.state.clear()
        return iter(out)

    def close(self) -> None:
        pass


class _Key:
    """State of one key of a bucket, as ``Segments`` calls it; its timer is the bucket's."""

    def __init__(self, held: tuple | None):
        self.held = held

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.held

    def update(self, held):
        self.held = held

    def clear(self):
        self.held = None

    def registerTimer(self, at):
        pass


class Buckets(StatefulProcessor):
    """``each`` for every key of a bucket. The bucket has a timer no later than the first that a key of it would have."""

    def __init__(self, each: Segments, keys: list[str], types: list[T.DataType]):
        self.each, self.keys = each, keys
        self.schema = T.StructType([*(T.StructField(f"key{i}", t) for i, t in enumerate(types)), *_STATE])

    def init(self, handle) -> None:
        self.handle = handle
        self.states = handle.getListState("open", self.schema)

    def _read(self) -> dict[str, tuple[tuple, tuple]]:
        """Key and state of each open key, by the key as text: NaN equals itself, and lists can be looked up."""
        k = len(self.keys)
        return {repr(tuple(x[:k])): (tuple(x[:k]), tuple(x[k:])) for x in self.states.get()}

    def _write(self, held: dict[str, tuple[tuple, tuple]]) -> None:
        if held:
            self.states.put([(*key, *state) for key, state in held.values()])
        else:
            self.states.clear()

    def _first(self, held: dict[str, tuple[tuple, tuple]]) -> float:
        """When the first of the keys is due."""
        return min((state[3] // 1000 + self.each.idle for _, state in held.values()), default=math.inf)

    def _of(self, key: tuple, name: str, held: dict[str, tuple[tuple, tuple]], call) -> list[Row]:
        """What ``call`` gives for one key; its state in ``held`` is brought up to date."""
        one = _Key(held[name][1] if name in held else None)
        self.each.init(one)
        out = list(call(key))
        if one.held is not None:
            held[name] = key, one.held
        else:
            held.pop(name, None)
        return out

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        points: dict[str, tuple[tuple, list[Row]]] = {}
        for r in rows:
            own = tuple([r[c] for c in self.keys])
            points.setdefault(repr(own), (own, []))[1].append(r)
        held, out = self._read(), []
        before = self._first(held)
        for name, (own, some) in points.items():
            out += self._of(own, name, held, lambda k, some=some: self.each.handleInputRows(k, iter(some), timerValues))
        if held:
            self._write(held)
            if (first := self._first(held)) < before:
                self.handle.registerTimer(first)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, out, now = self._read(), [], timerValues.getCurrentWatermarkInMs()
        if not held:
            return iter(out)
        for name, (own, state) in list(held.items()):
            if state[3] // 1000 + self.each.idle <= now:
                out += self._of(own, name, held, lambda k: self.each.handleExpiredTimer(k, timerValues, expiredTimerInfo))
        if out:
            self._write(held)
        if held:
            self.handle.registerTimer(self._first(held))
        return iter(out)

    def close(self) -> None:
        pass


def stream_segments(stream: DataFrame, keys: list[str], ts: str, tie: str, value: str, method: Method | int | str, bound: float = 0.0, late: str = "1 minute", idle_ms: int = 60_000, buckets: int = 512) -> DataFrame:
    """(keys, start_idx, end_idx, c0, c1, refused) of each segment when it closes: a stream of segment tables.

    ``ts`` is a timestamp, ``tie`` orders points of one instant; points later than ``late`` behind the
    newest are dropped by the watermark. A key whose values are all refused has no state, so a row without key and value only moves the watermark.
    A key whose timer has fired begins anew, at index 0. Keys fall into ``buckets``, of which a task holds one micro-batch's points and all
    states at a time; the number stays the same as long as a checkpoint is in use.
    """
    step, chained = _step(method_of(method), bound)
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = T.StructType([*(stream.schema[k] for k in keys), T.StructField("start_idx", T.LongType()), T.StructField("end_idx", T.LongType()), T.StructField("c0", T.DoubleType()), T.StructField("c1", T.DoubleType()), T.StructField("refused", T.LongType())])
    # microseconds as a number: order is exact, whatever pandas makes of timestamps
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket")
    rows = rows.select(*keys, bucket, F.col(ts).alias("event_time"), F.unix_micros(F.col(ts)).alias("ts"), F.col(tie).alias("tie"), value)
    each = Segments(step, chained, value, idle_ms, schema.names)
    return rows.groupBy("bucket").transformWithState(Buckets(each, keys, [stream.schema[k].dataType for k in keys]), schema, "append", "eventTime")


def replay(spark: SparkSession, table: DataFrame, ts: str, parts: int, path: str, after_days: int = 1) -> DataFrame:
    """A stream of the rows of ``table`` from ``parts`` groups of files by time, oldest first, one group a micro-batch.

    Each group is written by itself, so groups follow each other in age. Two rows with no key follow, ``after_days`` and twice that after all
    others: the first moves the watermark past every open segment, the second gives the micro-batch in which timers fire.
    """
    cuts = [i / parts for i in range(1, parts)]
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    bounds = table.agg(F.percentile_approx(micros, cuts, 1000).alias("q")).first()["q"] or []
    for i, (low, high) in enumerate(zip([None, *bounds], [*bounds, None])):
        rows = table
        if low is not None:
            rows = rows.where(micros > low)
        if high is not None:
            rows = rows.where(micros <= high)
        rows.coalesce(1).write.mode("append").parquet(path)
    end = table.agg(F.max(ts).alias(ts)).where(F.col(ts).isNotNull())
    for days in (after_days, 2 * after_days):
        moved = (F.col(ts) + F.expr(f"INTERVAL {days} DAY")).alias(ts)
        end.select(*[moved if c == ts else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns]).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(stream: DataFrame, path: str) -> DataFrame:
    """All that ``stream`` gives for the input that is there, as a table."""
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
