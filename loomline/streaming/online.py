"""Constant segments over a stream: one open segment per key as state, closed ones as output."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..methods import bound32

_OUT = [T.StructField("start_idx", T.LongType()), T.StructField("end_idx", T.LongType()), T.StructField("value", T.DoubleType())]
_STATE = T.StructType([T.StructField("start", T.LongType()), T.StructField("n", T.LongType()), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())])


def online_midrange(stream: DataFrame, key: str, order: str, value: str, bound: float) -> DataFrame:
    """(key, start_idx, end_idx, value) of each midrange segment when it is closed by a later point.

    Points of a key must come in order from batch to batch; within a batch they are sorted. The
    last segment of a key stays open as the state.
    """
    schema = T.StructType([stream.schema[key], *_OUT])
    limit = 2 * bound32(bound)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        start, n, lo, hi = state.get if state.exists else (0, 0, 0.0, 0.0)
        closed = []
        rows = pd.concat(list(frames)).sort_values(order)
        for v in rows[value].astype(float):
            a, b = (min(lo, v), max(hi, v)) if n else (v, v)
            if b - a > limit:
                closed.append((k[0], start, start + n, (lo + hi) / 2))
                start, n, a, b = start + n, 0, v, v
            lo, hi, n = a, b, n + 1
        state.update((start, n, lo, hi))
        yield pd.DataFrame(closed, columns=schema.names)

    return stream.groupBy(key).applyInPandasWithState(step, schema, _STATE, "append", "NoTimeout")
