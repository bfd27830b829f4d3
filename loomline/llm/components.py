"""Connected components of an edge table by repeated contraction.

Each round every node moves to the neighbour (or itself) with the smallest hash; edges are
renamed accordingly and become fewer by a constant factor in expectation, whatever the shape of
the graph. The moves are then followed back. Nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for each node of an edge.

    Loops and repeated edges do no harm; an empty table gives an empty result.
    """
    live = common.stage(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "edges")
    moves: list[DataFrame] = []
    while not live.isEmpty():
        if len(moves) >= max_rounds:
            raise RuntimeError("contraction does not end")
        both = live.union(live.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        move = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least(rank("a"), F.col("m"))["v"].alias("to"))
        move = common.stage(move, "moves")
        moves.append(move)
        nxt = live.join(move.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(move.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        nxt = common.stage(nxt.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), "edges")
        common.release(live)
        live = nxt
    common.release(live)
    if not moves:
        return edges.select(F.col("a").cast("long").alias("node"), F.col("b").cast("long").alias("component")).limit(0)
    at = moves[-1]
    for move in reversed(moves[:-1]):
        end = at.select(F.col("node").alias("__n"), F.col("to").alias("__t"))
        at = move.join(end, move["to"] == end["__n"], "left").select("node", F.coalesce("__t", "to").alias("to"))
    at = common.stage(at, "roots")
    for move in moves:
        common.release(move)
    least = at.groupBy("to").agg(F.min("node").alias("component"))
    return at.join(least, "to").select("node", "component")
