"""Score tables: normalising, fusing, matching with signatures, and late decisions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions import arrays as X
from seqloom.functions.tables import beside
from seqloom.operators.segments import segment_ids


def long_form(scores: DataFrame, score: str = "score") -> DataFrame:
    """(seq_id, t, class_id, s): one row a class."""
    return scores.select("seq_id", "t", F.posexplode(score).alias("class_id", "s"))


def normalize_scores(scores: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Log scores normalised over classes, or divided by a count (seq_id, t, n)."""
    if counts is None:
        return scores.withColumn("score", X.log_softmax(F.col("score")))
    return scores.join(counts, ["seq_id", "t"]).withColumn("score", F.transform("score", lambda x: x / F.col("n"))).drop("n")


def fit_moments(scores: DataFrame) -> DataFrame:
    """(class_id, mean, std): of each class over all frames; population deviation."""
    return long_form(scores).groupBy("class_id").agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"))


def standardize(scores: DataFrame, moments: DataFrame) -> DataFrame:
    """Long scores less their mean over their deviation; the moments have one row a class."""
    return long_form(scores).join(moments, "class_id").select("seq_id", "t", "class_id", ((F.col("s") - F.col("mean")) / F.col("std")).alias("s"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """(seq_id, t, rank, class_id, s): the best ``k`` classes of each frame, ties by class."""
    order = Window.partitionBy("seq_id", "t").orderBy(F.desc("s"), "class_id")
    return long_form(scores).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fuse_scores(a: DataFrame, b: DataFrame, method: str = "sum") -> DataFrame:
    """Scores of two sources at the same frames: their sum, or one of them (``first``, ``second``)."""
    both = a.select("seq_id", "t", F.col("score").alias("_a")).join(b.select("seq_id", "t", F.col("score").alias("_b")), ["seq_id", "t"])
    out = {"sum": X.add(F.col("_a"), F.col("_b")), "first": F.col("_a"), "second": F.col("_b")}[method]
    return both.select("seq_id", "t", out.alias("score"))


def concat_features(*tables: DataFrame) -> DataFrame:
    """Feature arrays of several modalities at the same frames, one after the other."""
    out = tables[0].select("seq_id", "t", F.col("score").alias("_0"))
    for i, x in enumerate(tables[1:], 1):
        out = out.join(x.select("seq_id", "t", F.col("score").alias(f"_{i}")), ["seq_id", "t"])
    return out.select("seq_id", "t", F.concat(*[f"_{i}" for i in range(len(tables))]).alias("score"))


def pair_scores(actions: DataFrame, parts: DataFrame, cooccurrence: DataFrame) -> DataFrame:
    """(seq_id, t, action, part, s): the best sum of an action and a part score among the pairs seen together (action, part)."""
    a = long_form(actions).select("seq_id", "t", F.col("class_id").alias("action"), F.col("s").alias("_a"))
    b = long_form(parts).select("seq_id", "t", F.col("class_id").alias("part"), F.col("s").alias("_b"))
    seen = a.join(cooccurrence.select("action", "part").distinct(), "action").join(b, ["seq_id", "t", "part"])
    best = F.max(F.struct((F.col("_a") + F.col("_b")).alias("s"), (-F.col("action")).alias("a"), (-F.col("part")).alias("p")))
    return seen.groupBy("seq_id", "t").agg(best.alias("x")).select("seq_id", "t", (-F.col("x.a")).alias("action"), (-F.col("x.p")).alias("part"), F.col("x.s").alias("s"))


def signature_scores(scores: DataFrame, signatures: list[list[float]], weight: float = 1.0) -> DataFrame:
    """Log-softmax over states of the weighted inner product with each state's signature."""
    products = [weight * X.dot(F.col("score"), F.array(*[F.lit(float(v)) for v in s])) for s in signatures]
    return scores.withColumn("score", X.log_softmax(F.array(*products)))


def one_hot_signature(value: Column, size: int) -> Column:
    """+1 at ``value``, -1 elsewhere; a negative value counts from the end."""
    at = F.when(value < 0, value + size).otherwise(value)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == at, F.lit(1)).otherwise(F.lit(-1)))


def distance_state_scores(distances: DataFrame, edges: DataFrame, scale: float = 1.0, alpha: float = 1.0) -> DataFrame:
    """(seq_id, t, state, s) from pair distances (seq_id, t, p1, p2, distance) and the edges (state, p1, p2, present) of each state.

    scale * sum(-distance) over present edges plus alpha for each absent one; unobserved pairs count for nothing.
    """
    joined = distances.filter("distance is not null").join(edges, ["p1", "p2"])
    s = F.sum(F.when(F.col("present"), -scale * F.col("distance")).otherwise(F.lit(alpha)))
    return joined.groupBy("seq_id", "t", "state").agg(s.alias("s"))


def class_average(scores: DataFrame, classes: DataFrame) -> DataFrame:
    """Mean score of the states of each symmetry class (state, cls)."""
    return scores.join(classes, "state").groupBy("seq_id", "t", "cls").agg(F.avg("s").alias("s"))


def joint_scores(events: DataFrame, states: DataFrame, allowed: DataFrame, w_event: float, w_state: float) -> DataFrame:
    """(seq_id, t, event, state, s): weighted sums over the allowed pairs (event, state)."""
    e = long_form(events).select("seq_id", "t", F.col("class_id").alias("event"), F.col("s").alias("_e"))
    s = long_form(states).select("seq_id", "t", F.col("class_id").alias("state"), F.col("s").alias("_s"))
    return e.join(allowed, "event").join(s, ["seq_id", "t", "state"]).select("seq_id", "t", "event", "state", (w_event * F.col("_e") + w_state * F.col("_s")).alias("s"))


def lookup_event(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Adds event: of the rows (action, part, event, row) that fit, the first; without a part the action alone decides."""
    first = table.groupBy("action", "part").agg(F.min_by("event", "row").alias("event"))
    return pairs.join(first, pairs["action"].eqNullSafe(first["action"]) & pairs["part"].eqNullSafe(first["part"]), "left").select(*[pairs[c] for c in pairs.columns], "event")


def gaussian_scores(points: DataFrame, params: DataFrame) -> DataFrame:
    """(seq_id, t, cls, s): log density of (x, y) under each class's axis-aligned Gaussian (mx, my, vx, vy); missing points score -inf."""
    quad = F.pow(F.col("x") - F.col("mx"), 2) / F.col("vx") + F.pow(F.col("y") - F.col("my"), 2) / F.col("vy")
    s = -0.5 * (quad + F.log(F.col("vx") * F.col("vy"))) - math.log(2 * math.pi)
    return beside(points, params).select("seq_id", "t", "cls", F.coalesce(s, F.lit(float("-inf"))).alias("s"))


def bin_match_scores(actions: DataFrame, bins: DataFrame, match: float) -> DataFrame:
    """(action, bin, s): log match if the bin holds the action, else log of the rest; ``bins`` is (bin, contents array)."""
    return beside(actions, bins).select("action", "bin", F.when(F.array_contains("contents", F.col("action")), math.log(match)).otherwise(math.log(1 - match)).alias("s"))


def split_signals(frames: DataFrame, only_active: bool = True) -> DataFrame:
    """Each (seq_id, signal_id) a sequence of its own; signals whose label is never set are left out on request."""
    if not only_active:
        return frames
    on = frames.groupBy("seq_id", "signal_id").agg(F.max(F.col("label") != 0).alias("_on")).filter("_on")
    return frames.join(on, ["seq_id", "signal_id"], "left_semi")


def join_signals(frames: DataFrame, value: str) -> DataFrame:
    """(seq_id, t, values): the signals of a frame as an array in the order of their ids."""
    return frames.groupBy("seq_id", "t").agg(F.transform(F.sort_array(F.collect_list(F.struct("signal_id", value))), lambda x: x[value]).alias("values"))


def vote_group(scores: DataFrame, membership: DataFrame) -> DataFrame:
    """(seq_id, model): the model with the largest log score summed over frames; a frame's score is the log-sum-exp over the parts (part, model)."""
    parts = long_form(scores).join(membership, F.col("class_id") == F.col("part"))
    per = parts.groupBy("seq_id", "t", "model").agg((F.max("s") + F.log(F.sum(F.exp(F.col("s"))) / F.exp(F.max("s")))).alias("s"))
    totals = per.groupBy("seq_id", "model").agg(F.sum("s").alias("s"))
    best = F.row_number().over(Window.partitionBy("seq_id").orderBy(F.desc("s"), "model"))
    return totals.withColumn("_r", best).filter("_r = 1").select("seq_id", "model")


def nearest_centers(points: DataFrame, centers: DataFrame) -> DataFrame:
    """(seq_id, seg_id, bin, n, x, y): points by nearest centre (bin, cx, cy), runs of one bin collapsed to their mean place."""
    tied = beside(points, centers)
    gap = F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)
    near = tied.groupBy("seq_id", "t").agg(F.min(F.struct(gap.alias("d"), "bin")).alias("m"), F.first("x").alias("x"), F.first("y").alias("y"))
    runs = segment_ids(near.withColumn("bin", F.col("m.bin")), "bin")
    return runs.groupBy("seq_id", "seg_id", "bin").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))
