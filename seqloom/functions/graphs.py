"""Components of many graphs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.storage import discard, stored


def grouped_components(edges: DataFrame, *scope: str, few: int = 64) -> tuple[DataFrame, DataFrame | None]:
    """(scope, groups), the components of each scope with at most ``few`` edges as arrays of vertices; and the edges of all other scopes, None if there are none.

    A small graph is one row and one fold over its edges, so it takes one shuffle rather than some for each round.
    """
    ends = edges.select(*scope, "a", "b").dropna(subset=[*scope, "a", "b"])
    large = stored(ends.groupBy(*scope).agg(F.count("*").alias("_n")).filter(F.col("_n") > few).select(*scope))
    rest = None
    if not large.isEmpty():
        rest, ends = ends.join(large, [*scope], "left_semi"), ends.join(large, [*scope], "left_anti")
    kind = ends.select(F.array("a", "b").alias("x")).schema["x"].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>")

    def joined(groups: Column, e: Column) -> Column:
        met = lambda g: F.array_contains(g, e["a"]) | F.array_contains(g, e["b"])
        return F.concat(F.filter(groups, lambda g: ~met(g)), F.array(F.array_distinct(F.concat(F.array(e["a"], e["b"]), F.flatten(F.filter(groups, met))))))

    rows = ends.groupBy(*scope).agg(F.collect_list(F.struct("a", "b")).alias("_e"))
    return rows.select(*scope, F.aggregate("_e", none, joined).alias("groups")), rest


def components(edges: DataFrame, *scope: str, most_rounds: int = 64, few: int = 64) -> DataFrame:
    """(scope, v, l): the least vertex that each vertex of an edge (scope, a, b) is connected with, within its scope.

    Scopes of at most ``few`` edges are folded (``grouped_components``), others settle in rounds. Edges with a null end or scope are left out.
    """
    if not scope:
        return components_by_rounds(edges, most_rounds=most_rounds)
    small, rest = grouped_components(edges, *scope, few=few)
    folded = small.select(*scope, F.explode("groups").alias("_g")).select(*scope, F.explode("_g").alias("v"), F.array_min("_g").alias("l"))
    return folded if rest is None else folded.unionByName(components_by_rounds(rest, *scope, most_rounds=most_rounds))


def components_by_rounds(edges: DataFrame, *scope: str, most_rounds: int = 64) -> DataFrame:
    """``components`` of graphs of any size.

    Every vertex points at a smaller one. A round hooks a vertex and the one it points at below the least grandparent
    among its neighbours, then lets all point at their grandparents, so distances halve and a chain of n vertices settles in
    about log n rounds rather than n. When no grandparent has moved, every vertex points at the least one.
    A round is one written table; the one before is deleted. Edges with a null end are left out, loops make a component of one.
    """
    ends = edges.select(*scope, "a", "b").dropna(subset=["a", "b"])
    both = stored(ends.unionByName(ends.select(*scope, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    keys = [*scope, "v"]
    label = stored(both.select(*scope, F.col("a").alias("v")).distinct().withColumns({"l": F.col("v"), "_g": F.col("v")}))
    for _ in range(most_rounds):
        seen = label.select(*scope, F.col("v").alias("b"), "_g")
        near = both.join(seen, [*scope, "b"]).groupBy(*scope, F.col("a").alias("v")).agg(F.min("_g").alias("_m"))
        own = F.struct("v", F.least("l", "_g", "_m").alias("l"), F.col("_g").alias("_was"))
        above = F.struct(F.col("l").alias("v"), F.col("_m").alias("l"), F.lit(None).alias("_was"))
        hooked = label.join(near, keys).select(*scope, F.inline(F.array(own, above))).groupBy(*keys).agg(F.min("l").alias("l"), F.max("_was").alias("_was"))
        parent = hooked.select(*scope, F.col("v").alias("l"), F.col("l").alias("_g"))
        new = stored(hooked.join(parent, [*scope, "l"]).select(*keys, "l", "_g", (F.col("_g") != F.col("_was")).alias("_moved")))
        discard(label)
        label = new
        if new.filter("_moved").isEmpty():
            discard(both)
            return label.select(*keys, "l")
    raise RuntimeError("components did not settle")
