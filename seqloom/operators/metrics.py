"""Frame, segment and vocabulary metrics, and what compares experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.operators.segments import to_segments


def accuracy(labels: DataFrame, *keys: str, equal: Column | None = None) -> DataFrame:
    """(keys, accuracy): share of frames where pred equals true, or where ``equal`` holds."""
    same = F.col("pred").eqNullSafe(F.col("truth")) if equal is None else equal
    return labels.groupBy(*keys).agg(F.avg(same.cast("double")).alias("accuracy"))


def prf(labels: DataFrame, *keys: str, background: int = 0) -> DataFrame:
    """(keys, tp, fp, fn, precision, recall, f1): the background class counts for nothing; null where nothing was there."""
    true, pred = F.col("truth"), F.col("pred")
    count = lambda c: F.sum(c.cast("long"))
    out = labels.groupBy(*keys).agg(
        count((pred == true) & (true != background)).alias("tp"), count((pred != background) & (pred != true)).alias("fp"), count((true != background) & (pred != true)).alias("fn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumn("precision", F.try_divide(tp, tp + fp)).withColumn("recall", F.try_divide(tp, tp + fn)).withColumn("f1", F.try_divide(2 * tp, 2 * tp + fp + fn))


def attribute_prf(labels: DataFrame, attributes: DataFrame) -> DataFrame:
    """(attr, tp, fp, fn, tn) of binary attributes of the labels (label, attr, value)."""
    true = attributes.select(F.col("label").alias("truth"), "attr", F.col("value").alias("_t"))
    pred = attributes.select(F.col("label").alias("pred"), "attr", F.col("value").alias("_p"))
    pairs = labels.groupBy("truth", "pred").count()  # frames are counted before the attributes fan out
    tied = pairs.join(true, "truth").join(pred, ["pred", "attr"])
    count = lambda a, b: F.sum(F.when((F.col("_t") == a) & (F.col("_p") == b), F.col("count")).otherwise(0))
    return tied.groupBy("attr").agg(count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(0, 0).alias("tn"))


def edit_score(labels: DataFrame) -> DataFrame:
    """(seq_id, edit): 1 - Levenshtein distance of the segment labels over the longer of the two.

    Labels are numbered within their sequence, and each number is one character from U+10000 on, which leaves room for a million classes.
    """
    runs = [to_segments(labels.select("seq_id", "t", F.col(c).alias("label"))).select("seq_id", "seg_id", "label", F.lit(c).alias("side")) for c in ("truth", "pred")]
    numbered = runs[0].unionByName(runs[1]).withColumn("_n", F.dense_rank().over(Window.partitionBy("seq_id").orderBy("label")))
    letter = F.decode(F.unhex(F.lpad(F.hex(F.col("_n") + 0x10000), 8, "0")), "UTF-32")
    side = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == c, F.struct("seg_id", "_c")))), lambda x: x["_c"]), "")
    text = numbered.withColumn("_c", letter).groupBy("seq_id").agg(side("truth").alias("_t"), side("pred").alias("_p"))
    return text.select("seq_id", (1 - F.levenshtein("_t", "_p") / F.greatest(F.length("_t"), F.length("_p"))).alias("edit"))


def overlap_score(labels: DataFrame, width: int = 256) -> DataFrame:
    """(seq_id, overlap): for each true segment the best IoU with a predicted one of its label, averaged; to six digits, half up.

    Segments meet in the stretches of ``width`` frames that they share, each pair in the first of them. Each IoU is a whole number of
    billionths, rounded down, so the mean is the same in whatever order they are added.
    """
    at = lambda c: F.floor(F.col(c) / width)
    runs = lambda c: to_segments(labels.select("seq_id", "t", F.col(c).alias("label")))
    true = runs("truth").select("seq_id", "label", "seg_id", "start", "end").withColumn("_w", F.explode(F.sequence(at("start"), at("end"))))
    pred = runs("pred").select(F.col("seq_id").alias("_s"), F.col("label").alias("_l"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    pred = pred.withColumn("_v", F.explode(F.sequence(at("_a"), at("_b"))))
    both = F.greatest(F.lit(0), F.least("end", "_b") - F.greatest("start", "_a") + 1)
    true_pred = F.greatest("end", "_b") - F.least("start", "_a") + 1
    iou = F.call_function("div", both.cast("long") * 1_000_000_000, true_pred)
    same = F.expr("seq_id = _s and label = _l and _w = _v and _a <= end and start <= _b") & (F.col("_w") == F.greatest(at("start"), at("_a")))
    met = F.when(F.col("_a").isNotNull(), iou)  # a segment that meets none has 0
    best = true.join(pred, same, "left").groupBy("seq_id", "seg_id").agg(F.coalesce(F.max(met), F.lit(0)).alias("iou"))
    total = best.groupBy("seq_id").agg(F.sum("iou").alias("_sum"), F.count("*").alias("_n"))
    return total.select("seq_id", (F.expr("(2 * _sum + 1000 * _n) div (2000 * _n)") / 1_000_000).alias("overlap"))


def confusion(labels: DataFrame) -> DataFrame:
    """(pred, true, n)."""
    return labels.groupBy("pred", "truth").agg(F.count("*").alias("n"))


def class_accuracy(labels: DataFrame) -> DataFrame:
    """(true, accuracy, n) of each class that occurs."""
    return labels.groupBy("truth").agg(F.avg((F.col("pred") == F.col("truth")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def compare_experiments(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pred, true, diff): the confusion counts of b less those of a."""
    x = confusion(a).withColumnRenamed("n", "_a")
    y = confusion(b).withColumnRenamed("n", "_b")
    return x.join(y, ["pred", "truth"], "full").select("pred", "truth", (F.coalesce("_b", F.lit(0)) - F.coalesce("_a", F.lit(0))).alias("diff"))


def leave_one_out(frames: DataFrame, label: str) -> DataFrame:
    """(seq_id, label, oov): whether a label of a sequence occurs in no other sequence."""
    here = frames.select("seq_id", F.col(label).alias("label")).distinct()
    spread = here.groupBy("label").agg(F.count("*").alias("_n"))
    return here.join(spread, "label").select("seq_id", "label", (F.col("_n") == 1).alias("oov"))


def oov_rate(test: DataFrame, train: DataFrame, label: str) -> DataFrame:
    """One row: the share of test frames whose label the training frames lack."""
    known = train.select(F.col(label).alias("_k")).distinct()
    return test.join(known, F.col(label) == F.col("_k"), "left").agg(F.avg(F.col("_k").isNull().cast("double")).alias("rate"))


def contextual_oov(frames: DataFrame, label: str) -> DataFrame:
    """(before_oov, rate, n): leave-one-out rate of unknown labels, by whether the one before was unknown."""
    flags = frames.select("seq_id", "t", F.col(label).alias("label")).join(leave_one_out(frames, label), ["seq_id", "label"])
    before = F.lag("oov").over(Window.partitionBy("seq_id").orderBy("t"))
    return flags.withColumn("before_oov", before).groupBy("before_oov").agg(F.avg(F.col("oov").cast("double")).alias("rate"), F.count("*").alias("n"))


def oov_predictions(labels: DataFrame) -> DataFrame:
    """(n, n_oov, n_right): predictions that no other sequence's truth holds, and how many of them are right."""
    here = labels.select("seq_id", F.col("truth").alias("label")).distinct()
    spread = here.groupBy("label").agg(F.count("*").alias("_n"))
    own = here.withColumn("_own", F.lit(1))
    tied = labels.join(spread, F.col("pred") == F.col("label"), "left").drop("label").join(own.withColumnRenamed("label", "pred"), ["seq_id", "pred"], "left")
    oov = F.coalesce("_n", F.lit(0)) - F.coalesce("_own", F.lit(0)) == 0
    return tied.agg(F.count("*").alias("n"), F.sum(oov.cast("long")).alias("n_oov"), F.sum((oov & (F.col("pred") == F.col("truth"))).cast("long")).alias("n_right"))


def correctable_errors(frames: DataFrame) -> DataFrame:
    """One row from (a, b score arrays, true): errors of a that b could mend, and predictions that differ."""
    best = lambda c: F.array_position(c, F.array_max(c)) - 1
    at = lambda c, i: F.coalesce(F.get(c, i.cast("int")), F.lit(float("-inf")))
    pa, pb = best("a"), best("b")
    mend = (pa != F.col("truth")) & (pb == F.col("truth")) & (at("b", F.col("truth")) > at("b", pa))
    return frames.agg(F.sum((pa != F.col("truth")).cast("long")).alias("errors"), F.sum(mend.cast("long")).alias("correctable"), F.sum((pa != pb).cast("long")).alias("changed"))


def segment_retrieval(segments: DataFrame, keyframes: DataFrame) -> DataFrame:
    """One row: segments with exactly one keyframe (tp), none (fp) and several (fn), as they are named there."""
    from seqloom.operators.labels import interval_join

    hits = interval_join(keyframes.select("seq_id", "t"), segments.select("seq_id", "seg_id", "start", "end")).groupBy("seq_id", "seg_id").agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    return segments.join(hits, ["seq_id", "seg_id"], "left").agg(*[F.sum(c.cast("long")).alias(k) for k, c in (("tp", n == 1), ("fp", n == 0), ("fn", n > 1))])


def adjusted_rand(labels: DataFrame) -> DataFrame:
    """(seq_id, ari): the adjusted Rand index of two segmentations, true and pred; 1 where both are one segment."""
    cells = labels.groupBy("seq_id", "truth", "pred").agg(F.count("*").alias("n"))
    two = lambda c: F.sum(c * (c - 1) / 2)
    both = cells.groupBy("seq_id").agg(two(F.col("n")).alias("_ij"), F.sum("n").alias("_all"))
    rows = cells.groupBy("seq_id", "truth").agg(F.sum("n").alias("n")).groupBy("seq_id").agg(two(F.col("n")).alias("_i"))
    cols = cells.groupBy("seq_id", "pred").agg(F.sum("n").alias("n")).groupBy("seq_id").agg(two(F.col("n")).alias("_j"))
    tied = both.join(rows, "seq_id").join(cols, "seq_id")
    expected = F.try_divide(F.col("_i") * F.col("_j"), F.col("_all") * (F.col("_all") - 1) / 2)
    ari = F.try_divide(F.col("_ij") - expected, (F.col("_i") + F.col("_j")) / 2 - expected)
    return tied.select("seq_id", F.coalesce(ari, F.lit(1.0)).alias("ari"))


def final_states(frames: DataFrame, state: str) -> DataFrame:
    """(seq_id, state) of the last frame."""
    return frames.groupBy("seq_id").agg(F.max_by(state, "t").alias(state))


def ratio_scores(scores: DataFrame) -> DataFrame:
    """(metric, num, den, value) summed over the sequences (metric, num, den)."""
    return scores.groupBy("metric").agg(F.sum("num").alias("num"), F.sum("den").alias("den")).withColumn("value", F.try_divide("num", "den"))


def mean_and_deviation(scores: DataFrame, *keys: str) -> DataFrame:
    """(keys, mean, std) of value in percent; population deviation."""
    return scores.groupBy(*keys).agg((100 * F.avg("value")).alias("mean"), (100 * F.stddev_pop("value")).alias("std"))
