"""Sequence bookkeeping and time alignment: common ids, clocks, as-of resampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def null_if_nan(df: DataFrame) -> DataFrame:
    """Every NaN as NULL: in Spark NaN compares as the largest number, missing data must not."""
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def load_metadata(df: DataFrame, key: str, criteria: dict, drop: list[str]) -> DataFrame:
    """Rows with all key and criteria columns set and equal to the criteria, without the dropped and unnamed columns; keys must be unique."""
    gone = [c for c in df.columns if c in drop or c.startswith("Unnamed")]
    out = df.drop(*gone).dropna(subset=[key, *criteria])
    return reduce(lambda x, kv: x.filter(F.col(kv[0]) == F.lit(kv[1])), criteria.items(), out)


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, count) of keys that are not unique."""
    return df.groupBy(key).count().filter("count > 1")


def fill_open_ends(actions: DataFrame) -> DataFrame:
    """Intervals whose end is 0 end where the next one of the sequence starts."""
    following = F.lead("start").over(Window.partitionBy("seq_id").orderBy("start", "ann_id"))
    return actions.withColumn("end", F.when(F.col("end") == 0, following).otherwise(F.col("end")))


def common_sequences(*tables: DataFrame) -> DataFrame:
    """Ids found in all tables."""
    return reduce(lambda a, b: a.join(b, "seq_id", "left_semi"), [t.select("seq_id") for t in tables[1:]], tables[0].select("seq_id").distinct())


def sequence_audit(**tables: DataFrame) -> DataFrame:
    """(seq_id, reason): which tables lack a sequence that another one has; null reason: none does."""
    flags = [t.select("seq_id", F.lit(n).alias("name")).distinct() for n, t in tables.items()]
    seen = reduce(DataFrame.unionByName, flags).groupBy("seq_id").agg(F.collect_set("name").alias("_have"))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(n) for n in tables]), F.col("_have")))
    return seen.select("seq_id", F.when(F.size(missing) > 0, F.concat(F.lit("no "), F.array_join(missing, ", "))).alias("reason"))


def equal_length_only(*tables: DataFrame) -> DataFrame:
    """(seq_id, n) of sequences that all tables hold with the same number of rows."""
    counts = [t.groupBy("seq_id").agg(F.count("*").alias("n")) for t in tables]
    return reduce(lambda a, b: a.join(b, ["seq_id", "n"]), counts)


def drop_invalid_sequences(df: DataFrame, *columns: str) -> DataFrame:
    """Rows of sequences in which no value of the columns is missing."""
    bad = df.filter(reduce(Column.__or__, [F.col(c).isNull() for c in columns])).select("seq_id").distinct()
    return df.join(bad, "seq_id", "left_anti")


def limit_sequences(df: DataFrame, most: int) -> DataFrame:
    """Rows of the first ``most`` sequences by id: ranks are taken over distinct ids only."""
    return df.join(df.select("seq_id").distinct().orderBy("seq_id").limit(most), "seq_id", "left_semi")


def subsample(df: DataFrame, period: int) -> DataFrame:
    """Every period-th frame, numbered anew."""
    return df.filter(F.col("t") % period == 0).withColumn("t", F.expr(f"cast(t div {period} AS int)"))


def unflatten_batches(items: DataFrame, index: DataFrame) -> DataFrame:
    """Batch items (batch_id, offset, ...) as frames, through ``index`` (batch_id, seq_id, win_start)."""
    return items.join(index, "batch_id").withColumn("t", F.col("win_start") + F.col("offset")).drop("batch_id", "win_start", "offset")


def attach_clip_scores(clips: DataFrame, scores: DataFrame, multi_label: bool = False) -> DataFrame:
    """Scores of clip rows joined back to their video; prediction by threshold 0.5 or by the first largest."""
    best = F.transform("score", lambda x: (x > 0.5).cast("int")) if multi_label else (F.array_position("score", F.array_max("score")) - 1).cast("int")
    return clips.join(scores, "clip_id").withColumn("pred", best)


def sample_per_sequence(df: DataFrame, n: int, rank: Column) -> DataFrame:
    """The ``n`` rows of each sequence that come first by ``rank``, a hash for a reproducible draw."""
    order = Window.partitionBy("seq_id").orderBy(rank, "t")
    return df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")


def sequence_bounds(samples: DataFrame) -> DataFrame:
    """(seq_id, lo, hi): the time that all sensors of a sequence cover; sequences without any are gone."""
    per = samples.groupBy("seq_id", "sensor").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    return per.groupBy("seq_id").agg(F.max("a").alias("lo"), F.min("b").alias("hi")).filter("lo <= hi")


def sample_grid(bounds: DataFrame, step_us: int) -> DataFrame:
    """(seq_id, i, us): times ``step_us`` apart from lo on, up to hi."""
    n = F.expr(f"(hi - lo) div {step_us}")
    return bounds.select("seq_id", "lo", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("i")).select("seq_id", "i", (F.col("lo") + F.col("i") * step_us).alias("us"))


def resample_nearest(samples: DataFrame, grid: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """``grid`` with the payload of the sample of the same keys nearest in time, the earlier one on a tie.

    An as-of join without a range join: both tables in one time order, the last sample before and
    the first one after a grid point, the nearer kept. One shuffle.
    """
    pay = F.struct(F.col("us").alias("_us"), *payload)
    extra = [c for c in grid.columns if c not in (*keys, "us")]
    left = grid.select(*keys, "us", F.struct(*extra).alias("_g") if extra else F.struct(F.lit(1)).alias("_g"), F.lit(None).cast(samples.select(pay.alias("p")).schema["p"].dataType).alias("_p"), F.lit(1).alias("_side"))
    right = samples.select(*keys, "us", F.lit(None).cast(left.schema["_g"].dataType).alias("_g"), pay.alias("_p"), F.lit(0).alias("_side"))
    order = Window.partitionBy(*keys).orderBy("us", "_side", *[f"_p.{c}" for c in payload])
    before = F.last("_p", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_p", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    both = left.unionByName(right).withColumn("_b", before).withColumn("_a", after).filter("_side = 1")
    near = F.when(F.col("_a").isNull() | (F.col("us") - F.col("_b._us") <= F.col("_a._us") - F.col("us")), F.col("_b")).otherwise(F.col("_a"))
    out = both.withColumn("_n", near)
    return out.select(*keys, "us", *[F.col(f"_g.{c}").alias(c) for c in extra], F.col("_n._us").alias("sample_us"), *[F.col(f"_n.{c}").alias(c) for c in payload])


def zero_for_missing(grid: DataFrame, samples: DataFrame, devices: list, value: str) -> DataFrame:
    """(seq_id, i, us, device, value, sample_us) for every listed device; one without samples reads 0 at no time."""
    wide = grid.withColumn("device", F.explode(F.array(*[F.lit(x) for x in devices])))
    near = resample_nearest(samples, wide, ["seq_id", "device"], [value])
    return near.withColumn(value, F.coalesce(value, F.lit(0.0)))


def map_intervals(intervals: DataFrame, clock1: DataFrame, clock2: DataFrame) -> DataFrame:
    """Interval ends as indices of clock 1 turned into the indices of clock 2 nearest in time; clocks are (seq_id, t, us)."""
    ends = intervals.select("seq_id", "ann_id", F.explode(F.array(F.struct(F.lit("start").alias("which"), F.col("start").alias("t")), F.struct(F.lit("end").alias("which"), F.col("end").alias("t")))).alias("x"))
    timed = ends.select("seq_id", "ann_id", "x.which", "x.t").join(clock1, ["seq_id", "t"]).drop("t")
    mapped = resample_nearest(clock2.select("seq_id", "us", "t"), timed, ["seq_id"], ["t"])
    return mapped.groupBy("seq_id", "ann_id").agg(F.max(F.when(F.col("which") == "start", F.col("t"))).alias("start"), F.max(F.when(F.col("which") == "end", F.col("t"))).alias("end"))


def pin_endpoints(intervals: DataFrame, lengths: DataFrame) -> DataFrame:
    """The first interval of a sequence starts at 0, the last ends at its last frame."""
    order = Window.partitionBy("seq_id").orderBy("start", "ann_id")
    marked = intervals.withColumn("_first", F.row_number().over(order) == 1).withColumn("_last", F.lead("ann_id").over(order).isNull())
    out = marked.join(lengths, "seq_id").withColumn("start", F.when(F.col("_first"), 0).otherwise(F.col("start")))
    return out.withColumn("end", F.when(F.col("_last"), F.col("n") - 1).otherwise(F.col("end"))).drop("_first", "_last", "n")


def frame_to_sample(names: DataFrame, frames: DataFrame, samples: DataFrame) -> DataFrame:
    """Frame names to frame indices to sample indices; of repeated keys the first index counts."""
    first = lambda df, key, value: df.groupBy("seq_id", key).agg(F.min(value).alias(value))
    return names.join(first(frames, "name", "frame"), ["seq_id", "name"], "left").join(first(samples, "frame", "sample"), ["seq_id", "frame"], "left")


def trim_before_first(samples: DataFrame, actions: DataFrame, code: int, lead: int = 0) -> DataFrame:
    """Samples after the first action of this code (``lead`` frames earlier, 0 at least); sequences without one are gone."""
    first = actions.filter(F.col("action") == code).groupBy("seq_id").agg(F.min("start").alias("_first"))
    return samples.join(first, "seq_id").filter(F.col("t") > F.greatest(F.col("_first") - lead, F.lit(0))).drop("_first")


def mean_clock(samples: DataFrame) -> DataFrame:
    """(seq_id, t, us): the mean time of an index over devices."""
    return samples.groupBy("seq_id", "t").agg(F.avg("us").alias("us"))


def truncate_to_shortest(samples: DataFrame) -> DataFrame:
    """Rows up to the last index that every device of the sequence has."""
    last = samples.groupBy("seq_id", "device").agg(F.max("t").alias("m")).groupBy("seq_id").agg(F.min("m").alias("_m"))
    return samples.join(last, "seq_id").filter("t <= _m").drop("_m")


def unmirror(samples: DataFrame, cutoff_us: int, value: str) -> DataFrame:
    """Sequences that began before the cut-over are mirrored back."""
    begin = F.min("us").over(Window.partitionBy("seq_id"))
    return samples.withColumn("_b", begin).withColumn(value, F.when(F.col("_b") < cutoff_us, -F.col(value)).otherwise(F.col(value))).drop("_b")


def at_keyframes(frames: DataFrame, keyframes: DataFrame, period: int = 1) -> DataFrame:
    """Frames at the listed indices (of every period-th frame), numbered anew as ``i``."""
    keys = keyframes.select("seq_id", F.expr(f"t div {period}").cast("int").alias("t")).distinct()
    return frames.join(keys, ["seq_id", "t"]).withColumn("i", F.row_number().over(Window.partitionBy("seq_id").orderBy("t")) - 1)
