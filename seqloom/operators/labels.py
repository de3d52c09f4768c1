"""Interval annotations and frame labels.

Interval joins are equi joins on the sequence and a time bucket, with the exact bounds as the rest
of the condition, so a long sequence with many intervals does not compare every pair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval_join(frames: DataFrame, intervals: DataFrame, closed: bool = True, bucket: int = 64, how: str = "inner") -> DataFrame:
    """Rows of ``frames`` (seq_id, t) with each interval (seq_id, start, end) that covers them; ``closed``: the end counts."""
    last = F.col("end") if closed else F.col("end") - 1
    cut = intervals.withColumn("_iv_last", last).filter("_iv_last >= start")
    cut = cut.withColumn("_iv_b", F.explode(F.sequence(F.expr(f"floor(start / {bucket})"), F.expr(f"floor(_iv_last / {bucket})")))).withColumnRenamed("seq_id", "_iv_s")
    on = (F.col("seq_id") == F.col("_iv_s")) & (F.expr(f"floor(t / {bucket})") == F.col("_iv_b")) & F.col("t").between(F.col("start"), F.col("_iv_last"))
    return frames.join(cut, on, how).drop("_iv_s", "_iv_b", "_iv_last")


def _topmost(frames: DataFrame, intervals: DataFrame, closed: bool = True) -> DataFrame:
    """Each frame (seq_id, t are its key) with ``_l`` of the covering interval (seq_id, start, end, _l, _r) of highest ``_r``, and how many cover it, ``_n``.

    The frame's other columns travel along, so frames are shuffled once to their intervals and once to their key.
    """
    packed = frames.select("seq_id", "t", F.struct(*frames.columns).alias("_row"))
    hits = interval_join(packed, intervals, closed, how="left")
    top = hits.groupBy("seq_id", "t").agg(F.first("_row").alias("_row"), F.max_by("_l", "_r").alias("_l"), F.count("_r").alias("_n"))
    return top.select("_row.*", "_l", "_n")


def paint_labels(frames: DataFrame, annotations: DataFrame, label: str, default, rank: str = "ann_id", closed: bool = True) -> DataFrame:
    """``frames`` (seq_id, t) with the label of the last interval over each, by ``rank``, and how many cover it."""
    joined = _topmost(frames, annotations.select("seq_id", "start", "end", F.col(label).alias("_l"), F.col(rank).alias("_r")), closed)
    return joined.withColumn("label", F.coalesce("_l", F.lit(default))).withColumn("n_cover", F.col("_n")).drop("_l", "_n")


def paint_parts(frames: DataFrame, annotations: DataFrame, parts: list[str], rank: str = "ann_id") -> DataFrame:
    """``frames`` with one boolean a part, all from the last interval over each frame."""
    joined = _topmost(frames, annotations.select("seq_id", "start", "end", F.struct(*parts).alias("_l"), F.col(rank).alias("_r")))
    return joined.select(*frames.columns, *[F.coalesce(F.col(f"_l.{p}"), F.lit(False)).alias(p) for p in parts])


def action_mask(frames: DataFrame, actions: DataFrame, most_code: int = 7) -> DataFrame:
    """``frames`` with ``mask``: 0 inside an action whose code is at most ``most_code``, else 1."""
    painted = paint_labels(frames, actions.filter(F.col("action") <= most_code).withColumn("_on", F.lit(0)), "_on", 1)
    return painted.withColumnRenamed("label", "mask").drop("n_cover")


def activity_phase(frames: DataFrame, actions: DataFrame, most_code: int = 7) -> DataFrame:
    """``frames`` with ``phase``: 0 before the first action, 1 during, 2 after the last; tags don't count.

    Frames are often made by an explode, which Spark's size estimates don't see, so the join is never left to a broadcast.
    """
    span = actions.filter(F.col("action") <= most_code).groupBy("seq_id").agg(F.min_by("start", "ann_id").alias("_s"), F.max_by("end", "ann_id").alias("_e"))
    phase = F.when(F.col("t") < F.col("_s"), 0).when(F.col("t") > F.col("_e"), 2).otherwise(1)
    return frames.hint("merge").join(span, "seq_id").withColumn("phase", phase).drop("_s", "_e")


def bin_labels(frames: DataFrame, actions: DataFrame, bins: DataFrame, part: str = "part", null_bin: int = 0) -> DataFrame:
    """Frames painted with the bin of the part in hand; ``bins`` (part, bin) is a vocabulary."""
    return paint_labels(frames, actions.join(bins, part), "bin", null_bin)


def pair_labels(frames: DataFrame, actions: DataFrame) -> DataFrame:
    """(seq_id, t, lo, hi, label): action code + 1 for each unordered part pair, on half-open intervals; later actions win."""
    pairs = actions.select("seq_id", "start", "end", "ann_id", F.greatest("part1", "part2").alias("hi"), F.least("part1", "part2").alias("lo"), (F.col("action") + 1).alias("code"))
    hits = interval_join(frames.select("seq_id", "t"), pairs, closed=False)
    return hits.groupBy("seq_id", "t", "lo", "hi").agg(F.max_by("code", "ann_id").alias("label"))


def objects_in_interval(events: DataFrame, detections: DataFrame, most: int = 4) -> DataFrame:
    """Events (seq_id, ann_id, start, end) with args, the distinct categories seen in them in name order, and the first ``most`` of them as arg0 ...; null where there is none."""
    hits = interval_join(detections, events)
    sets = hits.groupBy("seq_id", "ann_id").agg(F.sort_array(F.collect_set("category")).alias("_c"))
    joined = events.join(sets, ["seq_id", "ann_id"], "left")
    return joined.select(*events.columns, F.col("_c").alias("args"), *[F.get("_c", F.lit(i)).alias(f"arg{i}") for i in range(most)])


def parse_event_name(events: DataFrame, rules: list[tuple[str, str, str]], name: str = "event") -> DataFrame:
    """Adds action: of the rules (kind prefix or suffix, text, action) that fit, the first wins."""
    tests = [(F.startswith(name, F.lit(x)) if kind == "prefix" else F.endswith(name, F.lit(x)), action) for kind, x, action in rules]
    out = reduce(lambda c, r: F.when(r[0], F.lit(r[1])).otherwise(c), reversed(tests), F.lit(None).cast("string"))
    return events.withColumn("action", out)


def flag_parts(events: DataFrame, parts: list[str], name: str = "event") -> DataFrame:
    """One boolean a part: the name holds it once the parts before it are taken out."""
    rest, flags = F.col(name), []
    for part in parts:
        flags.append(F.contains(rest, F.lit(part)).alias(part))
        rest = F.replace(rest, F.lit(part), F.lit(""))
    return events.select(*events.columns, *flags)


def event_name(action: Column, *args: Column) -> Column:
    """action(arg,arg) with the non-empty arguments in order."""
    real = F.filter(F.array(*args), lambda x: x.isNotNull() & (x != ""))
    return F.concat(action, F.lit("("), F.concat_ws(",", F.array_sort(real)), F.lit(")"))


def validate_intervals(annotations: DataFrame, lengths: DataFrame) -> DataFrame:
    """Violations: (seq_id, ann_id, reason) where an interval is empty or reaches past its sequence (seq_id, n)."""
    joined = annotations.join(lengths, "seq_id", "left")
    reason = F.when(F.col("end") <= F.col("start"), "empty").when(F.col("n").isNull() | (F.col("end") >= F.col("n")), "past end")
    return joined.select("seq_id", "ann_id", reason.alias("reason")).filter("reason is not null")


def expand_pairs(pairs: DataFrame, holes: DataFrame, both: bool = False) -> DataFrame:
    """Part pairs to hole pairs through ``holes`` (part1, part2, hole1, hole2), read in both directions."""
    swapped = holes.select(F.col("part2").alias("part1"), F.col("part1").alias("part2"), F.col("hole2").alias("hole1"), F.col("hole1").alias("hole2"))
    out = pairs.join(holes.unionByName(swapped).distinct(), ["part1", "part2"])
    if both:
        back = out.withColumn("_h", F.col("hole1")).withColumn("hole1", F.col("hole2")).withColumn("hole2", F.col("_h")).drop("_h")
        out = out.unionByName(back)
    return out


def until_first_touch(frames: DataFrame, actions: DataFrame, items: DataFrame, most_code: int = 1) -> DataFrame:
    """(seq_id, t, item, in_basket): 1 until the first action touching an item begins; untouched items stay 1.

    Items get their first touch before they meet the frames, which are neither broadcast (see ``activity_phase``) nor shuffled once more with their items.
    """
    touched = actions.filter(F.col("action") <= most_code).select("seq_id", "ann_id", "start", F.explode(F.array("object", "target")).alias("item")).filter("item is not null")
    first = touched.groupBy("seq_id", "item").agg(F.min_by("start", "ann_id").alias("_first"))
    wanted = items.select("seq_id", "item").distinct().join(first, ["seq_id", "item"], "left")
    grid = frames.select("seq_id", "t").hint("merge").join(wanted, "seq_id")
    flag = F.when(F.col("_first").isNull() | (F.col("t") < F.col("_first")), 1).otherwise(0)
    return grid.select("seq_id", "t", "item", flag.alias("in_basket"))


def resting_devices(devices: DataFrame, actions: DataFrame) -> DataFrame:
    """Devices (seq_id, device) that no action has as object or target."""
    touched = actions.select("seq_id", F.explode(F.array("object", "target")).alias("device")).filter("device is not null and device <> -1")
    return devices.join(touched, ["seq_id", "device"], "left_anti")

