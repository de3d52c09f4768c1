"""Windows and clips over frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.operators.segments import active_slices, segment_ids


def window_clips(frames: DataFrame, win: int, stride: int, label: str = "label") -> DataFrame:
    """(seq_id, anchor, start, end, label): one clip of ``win`` frames centred on every stride-th frame, cut at both ends of the sequence."""
    last = F.max("t").over(Window.partitionBy("seq_id"))
    start = F.greatest(F.col("t") - win // 2, F.lit(0))
    return frames.withColumn("_last", last).filter(F.col("t") % stride == 0).select(
        "seq_id", F.col("t").alias("anchor"), start.alias("start"), F.least(F.col("t") - win // 2 + win - 1, F.col("_last")).alias("end"), F.col(label).alias("label"))


def segment_clips(frames: DataFrame, event: str, others: list[str]) -> DataFrame:
    """One clip per run of ``event``; other columns by majority, the smallest on a tie."""
    votes = [F.mode(c, True).alias(c) for c in others]
    return segment_ids(frames, event).groupBy("seq_id", "seg_id", event).agg(F.min("t").alias("start"), F.max("t").alias("end"), *votes)


def fixed_windows(frames: DataFrame, size: int) -> DataFrame:
    """Adds ``win``: the number of the window of ``size`` frames; the last one may be short."""
    return frames.withColumn("win", F.expr(f"cast(t div {size} AS int)"))


def window_keyframes(frames: DataFrame, size: int, score: str = "score") -> DataFrame:
    """(seq_id, win, t): the first frame with the highest score of each window; windows without a score have no row."""
    return fixed_windows(frames, size).filter(F.col(score).isNotNull()).groupBy("seq_id", "win").agg((-F.max(F.struct(F.col(score), -F.col("t")))["col2"]).cast("int").alias("t"))


def segment_keyframes(frames: DataFrame, threshold: float, min_len: int, score: str = "score", prepend_first: bool = False) -> DataFrame:
    """(seq_id, start, end, t): the best frame of each run above the threshold that has ``min_len`` frames; frame 0 first on request."""
    runs = active_slices(frames, F.col(score) > threshold).filter(F.col("n") >= min_len)
    covered = runs.select("seq_id", "start", "end", F.explode(F.sequence("start", "end")).alias("t"))
    best = covered.join(frames.select("seq_id", "t", F.col(score).alias("_s")), ["seq_id", "t"]).groupBy("seq_id", "start", "end").agg(F.max(F.struct("_s", (-F.col("t")).alias("m"))).alias("x"))
    out = best.select("seq_id", "start", "end", (-F.col("x.m")).cast("int").alias("t"))
    if prepend_first:
        zero = frames.select("seq_id").distinct().select("seq_id", *[F.lit(0).alias(c) for c in ("start", "end", "t")])
        out = out.unionByName(zero)
    return out


def pair_corr(pairs: DataFrame, half: int = 2, eps: float = 1e-6, scale: float | None = None) -> DataFrame:
    """Moving uncentred correlation of signals a and b over 2 * half + 1 samples, mirrored at both ends; with ``scale`` the sum of products over it."""
    ends = F.max("t").over(Window.partitionBy("seq_id", "d1", "d2"))
    known = pairs.withColumn("_last", ends)
    here = known.select("seq_id", "d1", "d2", "t", "a", "b")
    low = known.filter((F.col("t") > 0) & (F.col("t") <= half)).withColumn("t", -F.col("t")).select(here.columns)
    high = known.filter((F.col("t") < F.col("_last")) & (F.col("t") >= F.col("_last") - half)).withColumn("t", 2 * F.col("_last") - F.col("t")).select(here.columns)
    around = Window.partitionBy("seq_id", "d1", "d2").orderBy("t").rowsBetween(-half, half)
    total = lambda c: F.sum(c).over(around)
    dot, aa, bb = total(F.col("a") * F.col("b")), total(F.col("a") * F.col("a")), total(F.col("b") * F.col("b"))
    corr = dot / (F.sqrt(aa * bb) + eps) if scale is None else dot / scale
    last = here.groupBy("seq_id", "d1", "d2").agg(F.max("t").alias("_m"))
    mirrored = here.unionByName(low).unionByName(high).withColumn("corr", corr)
    return mirrored.join(last, ["seq_id", "d1", "d2"]).filter((F.col("t") >= 0) & (F.col("t") <= F.col("_m"))).select("seq_id", "d1", "d2", "t", "corr")


def window_median_label(frames: DataFrame, half: int, label: str = "label") -> DataFrame:
    """(seq_id, t, label): the lower median label of the frames around."""
    around = Window.partitionBy("seq_id").orderBy("t").rowsBetween(-half, half)
    near = F.array_sort(F.collect_list(label).over(around))
    return frames.select("seq_id", "t", F.element_at(near, F.floor((F.size(near) + 1) / 2).cast("int")).alias("label"))


def batch_index(frames: DataFrame, batch: int) -> DataFrame:
    """(seq_id, win_start): where each batch of a sequence begins."""
    return frames.groupBy("seq_id").agg(F.max("t").alias("_m")).select("seq_id", F.explode(F.sequence(F.lit(0), F.col("_m"), F.lit(batch))).alias("win_start"))


def around_start(frames: DataFrame, actions: DataFrame, half: int = 8) -> DataFrame:
    """(seq_id, ann_id, t, near): frames around the start of an action (near) and the rest of the action."""
    from seqloom.operators.labels import interval_join

    last = frames.groupBy("seq_id").agg(F.max("t").alias("_m"))
    wide = actions.join(last, "seq_id").withColumn("_a", F.greatest(F.col("start") - half, F.lit(0))).withColumn("_b", F.least(F.col("start") + half, F.col("_m") - 1))
    span = wide.select("seq_id", "ann_id", F.least("_a", "start").alias("start"), F.greatest("_b", "end").alias("end"), "_a", "_b", F.col("start").alias("_s"), F.col("end").alias("_e"))
    near = F.col("t").between(F.col("_a"), F.col("_b"))
    return interval_join(frames.select("seq_id", "t"), span).filter(near | F.col("t").between(F.col("_s"), F.col("_e"))).select("seq_id", "ann_id", "t", near.alias("near"))

