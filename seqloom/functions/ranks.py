"""Exact order statistics without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.storage import discard, stored

#: Cells a round cuts a bracket into, and the accuracy of the sketch that places their borders.
CELLS, ACCURACY = 500, 10_000


def order_statistics(values: DataFrame, targets: DataFrame, value: str, *by: str, few: int = 10_000, most_targets: int = 100_000, most_rounds: int = 40) -> DataFrame:
    """(by, rank, value): the value at each 0-based rank of ``targets`` (by, rank) among the sorted values of its group; null past the end or before 0.

    Nulls and NaN are left out. Each round brackets a rank between two borders taken from mergeable quantile sketches, counts
    exactly what lies below, on, between and above them, and goes on with the rows of that part alone; as the borders are values
    that occur, every round leaves some rows behind. A sketch that misses costs a round, never a result. Brackets of one value are done; those of at most ``few`` rows are sorted, which is the most a task
    gathers. Up to ``most_targets`` brackets are broadcast, more are joined by key.
    """
    v = F.col(value)
    kept = values.filter(v.isNotNull() & ~F.isnan(v.cast("double"))).select(*by, v.alias("_v"))
    ends = kept.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    asked = targets.select(*by, "rank").dropna().distinct()
    open_ = stored(asked.join(ends, list(by)).filter("rank >= 0 and rank < _n").withColumn("_left", F.col("rank")))
    done, rows, spent = None, kept, [open_]
    for _ in range(most_rounds):
        alike = F.col("_lo") == F.col("_hi")
        small = open_.filter((F.col("_n") <= few) & ~alike)
        settled = open_.filter(alike).select(*by, "rank", F.col("_lo").alias(value))
        picked = _sorted_picks(rows, small, by, most_targets).withColumnRenamed("_at", value)
        found = stored(settled.unionByName(picked))
        done = found if done is None else done.unionByName(found)
        wide = open_.filter((F.col("_n") > few) & ~alike)
        if wide.isEmpty():
            for table in spent:
                discard(table)
            return asked.join(done, [*by, "rank"], "left")
        new = stored(_narrowed(rows, wide, by, most_targets))
        inside = stored(_within(rows, new.filter("_lo <> _hi"), by, most_targets).select(*by, "_v", "_lo", "_hi"))
        for table in spent:
            discard(table)
        open_, rows, spent = new.drop("_lo0", "_hi0"), inside, [new, inside]
    raise RuntimeError("ranks did not settle")


def _within(rows: DataFrame, brackets: DataFrame, by: tuple[str, ...], most: int) -> DataFrame:
    """Rows in each different bracket (by, _lo, _hi)."""
    each = brackets.select(*by, "_lo", "_hi").distinct()
    if "_lo" in rows.columns:
        # rows of a bracket that has been cut further: they travel once for each bracket that they lie in
        rows = rows.select(*by, "_v", F.col("_lo").alias("_lo0"), F.col("_hi").alias("_hi0"))
        each = brackets.select(*by, "_lo", "_hi", "_lo0", "_hi0").distinct() if "_lo0" in brackets.columns else each.withColumns({"_lo0": F.col("_lo"), "_hi0": F.col("_hi")})
    keys = [*by, *[c for c in ("_lo0", "_hi0") if c in rows.columns]]
    small = each.limit(most + 1).count() <= most
    tied = rows.join(F.broadcast(each) if small else each, keys)
    return tied.filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))


def _sorted_picks(rows: DataFrame, small: DataFrame, by: tuple[str, ...], most: int) -> DataFrame:
    """(by, rank, _at) of brackets with few rows."""
    lists = _within(rows, small, by, most).groupBy(*by, "_lo", "_hi").agg(F.sort_array(F.collect_list("_v")).alias("_all"))
    return lists.join(small, [*by, "_lo", "_hi"]).select(*by, "rank", F.get("_all", F.col("_left").cast("int")).alias("_at"))


def _narrowed(rows: DataFrame, wide: DataFrame, by: tuple[str, ...], most: int) -> DataFrame:
    """Open ranks with the part of their bracket that holds them, by exact counts."""
    keys = [*by, "_lo", "_hi"]
    grid = [i / CELLS for i in range(CELLS + 1)]
    inside = _within(rows, wide, by, most)
    borders = inside.groupBy(*keys).agg(F.percentile_approx("_v", grid, ACCURACY).alias("_q"))
    cell = F.floor(F.col("_left") / F.col("_n") * CELLS).cast("int")
    border = lambda i: F.get("_q", F.least(F.greatest(i, F.lit(0)), F.lit(CELLS)))
    cut = stored(wide.join(borders, keys).select(*keys, "rank", "_left", "_n", border(cell - 1).alias("_a"), border(cell + 2).alias("_b")))
    pairs = cut.select(*keys, "_a", "_b").distinct()
    small = pairs.limit(most + 1).count() <= most
    tied = inside.join(F.broadcast(pairs) if small else pairs, keys)
    v, a, b = F.col("_v"), F.col("_a"), F.col("_b")
    counts = tied.groupBy(*keys, "_a", "_b").agg(
        F.count_if(v < a).alias("_below"), F.count_if(v <= a).alias("_to_a"), F.count_if(v < b).alias("_under"), F.count_if(v <= b).alias("_to_b"),
        F.max(F.when(v < a, v)).alias("_before"), F.min(F.when(v > a, v)).alias("_first"), F.max(F.when(v < b, v)).alias("_last"), F.min(F.when(v > b, v)).alias("_after"),
    )
    at = cut.join(counts, [*keys, "_a", "_b"])
    c = F.col

    def part(below: Column, at_a: Column, between: Column, at_b: Column, above: Column) -> Column:
        return F.when(c("_left") < c("_below"), below).when(c("_left") < c("_to_a"), at_a).when(c("_left") < c("_under"), between).when(c("_left") < c("_to_b"), at_b).otherwise(above)

    return at.select(
        *by, "rank", c("_lo").alias("_lo0"), c("_hi").alias("_hi0"),
        part(c("_lo"), a, c("_first"), b, c("_after")).alias("_lo"), part(c("_before"), a, c("_last"), b, c("_hi")).alias("_hi"),
        part(c("_left"), c("_left") - c("_below"), c("_left") - c("_to_a"), c("_left") - c("_under"), c("_left") - c("_to_b")).alias("_left"),
        part(c("_below"), c("_to_a") - c("_below"), c("_under") - c("_to_a"), c("_to_b") - c("_under"), c("_n") - c("_to_b")).alias("_n"),
    )


def quantiles(values: DataFrame, value: str, shares: dict[str, float], *by: str, few: int = 10_000) -> DataFrame:
    """(by, one column a share): exact quantiles with linear interpolation between neighbours, nulls and NaN left out; a group without values is not listed."""
    v = F.col(value)
    kept = values.filter(v.isNotNull() & ~F.isnan(v.cast("double")))
    sizes = stored(kept.groupBy(*by).agg(F.count("*").alias("_n")))
    place = lambda p: (F.col("_n") - 1) * F.lit(float(p))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(p)), F.ceil(place(p))) for p in shares.values()])))
    found = order_statistics(kept, sizes.select(*by, F.explode(ranks).alias("rank")), value, *by, few=few)
    wide = sizes.join(found, list(by)).groupBy(*by, "_n").agg(F.map_from_entries(F.collect_list(F.struct("rank", value))).alias("_m"))  # two ranks a share

    def between(p: float) -> Column:
        low = F.floor(place(p))
        a, b = F.element_at("_m", low), F.element_at("_m", F.ceil(place(p)))
        return F.when(a == b, a).otherwise(a * (1 - (place(p) - low)) + b * (place(p) - low))

    return wide.select(*by, *[between(p).alias(name) for name, p in shares.items()])
