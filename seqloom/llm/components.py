"""Connected components of a large graph by alternating star contraction.

Each round replaces the edges of every vertex by edges to its smallest neighbour: first for the
larger neighbours, then for the smaller ones. Only (vertex, vertex) rows are shuffled, minima are
pre-aggregated before the shuffle, and a vertex with very many neighbours costs one row a
neighbour, so no group is gathered in one task. A round's table goes once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from seqloom.storage import discard, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a vertex moves to its smallest one; only vertices with neighbours on both sides have any to move, so the middle of a star has no row in ``low``."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("top")).filter("m < a and a < top").select("a", "m")
    return both.filter("b > a").join(low, "a", "left").select(F.col("b").alias("a"), F.coalesce("m", "a").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The stored edges, and their number and a sum over them, both taken while writing."""
    seen = Observation()
    out = stored(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")))
    return out, (seen.get["n"], seen.get["sum"])


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every vertex of ``edges`` (columns a, b): the smallest vertex it reaches.

    Self-edges, repeated edges and edges with a null change nothing; a vertex without an edge to another one has no
    row; an empty table gives an empty result.
    """
    now, mark = _written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        before, was = now, mark
        now, mark = _written(_small_star(_large_star(before)))
        discard(before)
        if mark == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
