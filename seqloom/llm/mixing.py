"""Mixing sources to target token counts by entropy balancing, with DataFrame operations only.

Rates are those nearest to one copy of each document, in the relative entropy of a quantity that
lies between 0 and ``cap``, that meet token constraints: the tokens of each source add up to its
target (exactly), and each length band, one for every octave of sizes, keeps its share of all tokens
(as nearly as ``softness`` asks, so that long documents do not vanish from a source that is cut). By
duality the rate of a document of x tokens, in source s and band b, is exponentially tilted:
r / (cap - r) grows with exp(x * (u_s + v_b)), and r is 1 without a tilt. The multipliers u and v of
all sources and bands are found together by Newton steps on the convex dual. A step sums gradient
and curvature over the histogram (source, size, documents), by source and band; the curvature
between sources is diagonal, so they are eliminated where they lie and only a system of the bands,
at most ``BANDS`` wide, is solved on the driver.

Rates become whole copies by systematic rounding along the sizes of a source: of the documents
with one source and size as many get the larger copy number as the running sum of rates asks for,
and those are chosen by hash. The error left is at most about one large document a source; a few
corrections then change the copies of the sizes that come nearest to what is missing.

Targets: a source has ``share`` of all tokens by weight, at most ``cap`` times its own tokens;
what is cut off is shared again by weight until no source is above its cap.

Defined results: a null or empty text has size 0 and is taken once; a null source is a source of its
own, last in order; a source without tokens has target 0, one at its cap takes every document ``cap``
times; repeated rows and rows without an id count as documents of their own; ties go by hash and id;
an empty table gives an empty result; reruns agree; ``mix`` returns its own columns only,
``apply_mix`` all columns of ``docs`` whatever their names. Targets are set over one row a source.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.llm.words import WORD
from seqloom.storage import stored


#: Length bands: octaves of sizes, the last one open.
BANDS = 16


@dataclass(frozen=True)
class MixParams:
    """``softness``: how far bands may miss their share. ``corrections``: sizes changed for each source after rounding. ``slices``: least hashed slices of documents of one source and size; one for each ``slice_rows`` documents."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    cap: float = 2.0
    softness: float = 0.05
    newton_steps: int = 30
    tolerance: float = 1e-9
    corrections: int = 4
    slices: int = 128
    slice_rows: int = 100_000


def sizes_of(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, source, size) of every row: size is the number of words."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))


def source_targets(per: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """Adds ``target`` to ``per`` (source, n_docs, source_size), one row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in p.weights])
    ranked = per.withColumn("weight", F.element_at(weights, F.pmod(F.row_number().over(order) - 1, F.lit(len(p.weights))).cast("int") + 1))
    # water filling: sources reach their cap in the order of cap over weight; the level is set by those that do not
    capped = ranked.withColumn("most", F.lit(p.cap) * F.col("source_size")).withColumn("at", F.col("most") / F.col("weight"))
    run = Window.orderBy("at", F.col("source").asc_nulls_last())
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    total = F.lit(p.share) * F.sum("source_size").over(whole)
    left = total - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(run.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = capped.withColumn("level", left / weight_left).withColumn("place", F.row_number().over(run))
    level = F.min(F.when(F.col("level") <= F.col("at"), F.struct("place", "level"))).over(whole)["level"]
    target = F.when(level.isNull(), F.col("most")).otherwise(F.least("most", level * F.col("weight")))
    return levels.withColumn("target", target).select("source", "n_docs", "source_size", "target")


def _band(size: Column) -> Column:
    return F.least(F.lit(BANDS - 1), F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int"))


def _tilted(x: Column, u: Column, v: Column, cap: float) -> Column:
    """The rate of a document of x scaled tokens under the multipliers of its source and band."""
    return F.lit(cap) / (1 + (cap - 1) * F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), x * (u + v)))))


def _multipliers(histogram: DataFrame, targets: DataFrame, p: MixParams) -> tuple[DataFrame, np.ndarray, float]:
    """(source, full, u), one row a source, the multipliers v of the bands, and the tokens that count as one.

    ``full``: the target is the cap, so no tilt is sought.
    """
    total = targets.agg(F.sum("source_size"), F.sum("n_docs")).first()
    unit = (total[0] or 1) / (total[1] or 1) or 1.0
    full = F.col("target") >= p.cap * F.col("source_size") * (1 - 1e-9)
    now = targets.select(F.col("source").alias("s"), full.alias("full"), (F.col("target") / unit).alias("t"), F.lit(0.0).alias("u"))
    v = np.zeros(BANDS)
    x = F.col("size") / unit
    cells = histogram.join(targets.select(F.col("source").alias("s"), full.alias("full")), _same("source", "s")).withColumn("x", x)
    bands = cells.groupBy(_band(F.col("size")).alias("band")).agg(F.sum(F.col("docs") * x).alias("all"), F.sum(F.when(F.col("full"), F.col("docs") * x)).alias("fixed"), F.sum(F.col("docs") * x * x).alias("square")).collect()
    if not bands or not any(r["all"] for r in bands):
        return now.select(F.col("s").alias("source"), "full", "u"), v, unit
    sought = now.filter("not full").agg(F.sum("t")).first()[0] or 0.0
    everything = sought + p.cap * sum(r["fixed"] or 0.0 for r in bands)
    want = np.zeros(BANDS)
    for r in bands:
        want[r["band"]] = r["all"] / sum(y["all"] for y in bands) * everything - p.cap * (r["fixed"] or 0.0)
    hold = p.softness * sum(r["square"] for r in bands) / BANDS
    for _ in range(p.newton_steps):
        rate = _tilted(x, F.col("u"), F.element_at(F.array(*[F.lit(float(y)) for y in v]), _band(F.col("size")) + 1), p.cap)
        tied = histogram.join(now.filter("not full and t > 0"), _same("source", "s"))
        slope = F.col("docs") * x * x * rate * (1 - rate / p.cap)
        sums = tied.groupBy("s", "full", "t", "u", _band(F.col("size")).alias("band")).agg(F.sum(F.col("docs") * x * rate).alias("g"), F.sum(slope).alias("h"))
        sums = stored(sums.groupBy("s", "full", "t", "u").agg(F.collect_list(F.struct("band", "g", "h")).alias("cells")))  # at most BANDS cells a source
        add = lambda c: F.aggregate("cells", F.lit(0.0), lambda acc, y: acc + y[c])
        off, curve = add("g") - F.col("t"), add("h") + 1e-9
        across = F.flatten(F.transform("cells", lambda i: F.transform("cells", lambda j: F.struct(i["band"].alias("i"), j["band"].alias("j"), (i["h"] * j["h"] / curve).alias("s")))))
        pairs = sums.select(F.explode(across).alias("y")).groupBy("y.i", "y.j").agg(F.sum("y.s").alias("s")).collect()  # at most BANDS ** 2 rows
        own = sums.select(F.explode("cells").alias("y"), off.alias("off"), curve.alias("curve"), (F.abs(off) / F.col("t")).alias("miss")).groupBy("y.band").agg(
            F.sum("y.g").alias("g"), F.sum("y.h").alias("h"), F.sum(F.col("y.h") * F.col("off") / F.col("curve")).alias("push"), F.max("miss").alias("miss")).collect()
        if not own:
            break
        system, right = np.diag(np.full(BANDS, hold)), hold * v - want
        for r in pairs:
            system[r["i"], r["j"]] -= r["s"]
        for r in own:
            system[r["band"], r["band"]] += r["h"]
            right[r["band"]] += r["g"] - r["push"]
        move = -np.linalg.solve(system, right)
        miss = max(max(r["miss"] for r in own), np.abs(right).max() / max(sought, 1e-300))
        if miss <= p.tolerance:
            now = sums.select("s", "full", "t", "u")
            break
        pull = F.aggregate("cells", F.lit(0.0), lambda acc, y: acc + y["h"] * F.element_at(F.array(*[F.lit(float(m)) for m in move]), y["band"] + 1))
        step = -(off + pull) / curve
        most = 1 + F.abs("u")
        now = sums.select("s", "full", "t", (F.col("u") + F.greatest(-most, F.least(most, step))).alias("u"))
        v = v + np.clip(move, -1 - np.abs(v), 1 + np.abs(v))
    ended = targets.select("source", full.alias("full")).join(now.filter("not full").select("s", "u"), _same("source", "s"), "left")
    return ended.select("source", "full", F.coalesce("u", F.lit(0.0)).alias("u")), v, unit


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _changed(counted: DataFrame, changes: DataFrame) -> DataFrame:
    """``counted`` with ``change``, what the corrections so far add to the copies of a source and size."""
    summed = changes.groupBy("source", "size").agg(F.sum("change").alias("change")).select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), "change")
    return counted.join(summed, _same("source", "c_source") & (F.col("size") == F.col("c_size")), "left").select(*counted.columns, F.coalesce("change", F.lit(0).cast("long")).alias("change"))


def mix(docs: DataFrame, p: MixParams = MixParams(), text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, rate, copies, taken (copies times size) and row_copy.

    ``row_copy`` tells repeated rows of one id apart: 1, 2, ...
    """
    rows = sizes_of(docs, text_col, source_col, id_col)
    # rows that agree in id, source and size are interchangeable: they are counted, not listed
    units = stored(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")))
    expanded = units.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("row_copy"))
    histogram = stored(expanded.groupBy("source", "size").agg(F.count("*").alias("docs")))
    per = histogram.groupBy("source").agg(F.sum("docs").alias("n_docs"), F.sum(F.col("docs") * F.col("size")).alias("source_size"))
    targets = stored(source_targets(per, p))
    solved, v, unit = _multipliers(histogram, targets, p)
    solved = stored(solved.select(F.col("source").alias("s"), "full", "u"))
    tilt = _tilted(F.col("size") / unit, F.col("u"), F.element_at(F.array(*[F.lit(float(y)) for y in v]), _band(F.col("size")) + 1), p.cap)
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("full"), F.lit(p.cap)).otherwise(tilt)
    rated = histogram.join(solved, _same("source", "s")).select("source", "size", "docs", rate.alias("rate"))
    # systematic rounding: the running sum of rates by size tells how many copies each size has
    run = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(F.col("docs") * F.col("rate")).over(run)
    there = F.floor(F.round(upto, 6) + 0.5)
    counted = rated.withColumn("upto", there).withColumn("copies_here", F.col("upto") - F.coalesce(F.lag("upto").over(Window.partitionBy("source").orderBy("size")), F.lit(0)))
    counted = stored(counted.select("source", "size", "docs", "rate", "copies_here"))
    goal = targets.select(F.col("source").alias("s"), "source_size", "target", "n_docs")
    # corrections: in each source the size that comes nearest below what is missing or over, as often as it fits
    changes = None
    for _ in range(p.corrections):
        at = counted.withColumn("change", F.lit(0).cast("long")) if changes is None else _changed(counted, changes)
        gone = at.groupBy("source").agg(F.sum((F.col("copies_here") + F.col("change")) * F.col("size")).alias("taken")).join(goal, _same("source", "s")).select("s", (F.col("target") - F.col("taken")).alias("missing"))
        fits = F.floor(F.abs("missing") / F.col("size"))
        spare = F.when(F.col("missing") > 0, F.floor(p.cap * F.col("docs")) - F.col("copies_here") - F.col("change")).otherwise(F.col("copies_here") + F.col("change"))
        best = at.filter("size > 0").join(gone, _same("source", "s")).withColumn("k", F.least(fits, spare).cast("long")).filter("k > 0")
        step = stored(best.groupBy("source").agg(F.max(F.struct("size", "k")).alias("x"), F.first("missing").alias("missing")).select("source", "x.size", (F.signum("missing").cast("long") * F.col("x.k")).alias("change")))
        if step.isEmpty():
            break
        changes = step if changes is None else changes.unionAll(step)
    counted = counted if changes is None else _changed(counted, changes).select("source", "size", "docs", "rate", (F.col("copies_here") + F.col("change")).alias("copies_here"))
    split = counted.select("source", "size", "rate", F.expr("copies_here div docs").alias("least"), (F.col("copies_here") % F.col("docs")).alias("more"))
    slices = max(p.slices, (targets.agg(F.sum("n_docs")).first()[0] or 0) // p.slice_rows)
    cut = expanded.withColumn("slice", F.pmod(F.xxhash64("doc_id", "row_copy"), F.lit(slices)))
    in_slice = cut.groupBy("source", "size", "slice").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    key = ["source", "size", "slice"]
    offsets = in_slice.select(*[F.col(c).alias(f"o_{c}") for c in key], before.alias("before"))
    local = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "row_copy"))
    ranked = cut.withColumn("local", local).join(offsets, _same("source", "o_source") & (F.col("size") == F.col("o_size")) & (F.col("slice") == F.col("o_slice")))
    split = split.select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), "rate", "least", "more")
    copies = (F.col("least") + F.when(F.col("before") + F.col("local") <= F.col("more"), 1).otherwise(0)).cast("long")
    final = ranked.join(split, _same("source", "p_source") & (F.col("size") == F.col("p_size"))).select("doc_id", "source", "size", "row_copy", "rate", copies.alias("copies"))
    final = final.join(goal, _same("source", "s"))
    return final.select(
        F.col("doc_id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate", "row_copy"
    )


def apply_mix(docs: DataFrame, p: MixParams = MixParams(), text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """Each row of ``docs`` as often as the mix takes it, columns unchanged.

    Repeated rows with one id, source and size share their copies evenly, the odd ones going to the first texts.
    """
    # one key without nulls for the join and the window after it, so texts are shuffled once
    key = lambda i, c, n: F.concat_ws("/", F.coalesce(i.cast("string"), F.lit("")), n, F.when(c.isNull(), "n").otherwise(F.concat(F.lit("s"), c)))
    own = f"m{uuid.uuid4().hex}_"  # no column of a caller has this name
    plan = mix(docs, p, text_col, source_col, id_col)
    plan = plan.groupBy(key(F.col(id_col), F.col(source_col), F.col("size")).alias(f"{own}plan")).agg(F.sum("copies").alias(f"{own}copies"), F.count("*").alias(f"{own}rows"))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.withColumn(f"{own}key", key(F.col(id_col), F.col(source_col), size))
    tied = sized.join(plan.filter(F.col(f"{own}copies") > 0), F.col(f"{own}key") == F.col(f"{own}plan"))
    tied = tied.withColumn(f"{own}at", F.row_number().over(Window.partitionBy(f"{own}key").orderBy(F.xxhash64(text_col))))
    copies = F.expr(f"{own}copies div {own}rows") + F.when(F.col(f"{own}at") <= F.col(f"{own}copies") % F.col(f"{own}rows"), 1).otherwise(0)
    times = F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies.cast("long")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return tied.select(*columns, F.explode(times).alias(f"{own}i")).select(*columns)
