"""Run-length segments of label sequences: all by one window over a sequence's time order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def in_order(*order: str) -> Window:
    """A sequence in time order; the columns must order its rows totally."""
    return Window.partitionBy("seq_id").orderBy(*order)


def change_flag(label: str, order: str = "t") -> Column:
    """1 where a label differs from the one before it or is the first."""
    before = F.lag(label).over(in_order(order))
    return F.when(before.eqNullSafe(F.col(label)) & (F.row_number().over(in_order(order)) > 1), 0).otherwise(1)


def segment_ids(df: DataFrame, label: str = "label", order: str = "t", out: str = "seg_id") -> DataFrame:
    """Adds the segment number 0, 1, 2, ... of each frame."""
    flagged = df.withColumn("_new", change_flag(label, order))
    return flagged.withColumn(out, F.sum("_new").over(in_order(order)) - 1).drop("_new")


def to_segments(df: DataFrame, label: str = "label") -> DataFrame:
    """(seq_id, seg_id, start, end, label, n): maximal runs of one label; ends are inclusive."""
    return segment_ids(df, label).groupBy("seq_id", "seg_id", F.col(label).alias("label")).agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n"))


def from_segments(segments: DataFrame) -> DataFrame:
    """(seq_id, t, label): one row a frame."""
    return segments.select("seq_id", F.explode(F.sequence("start", "end")).alias("t"), "label")


def active_slices(df: DataFrame, active: Column) -> DataFrame:
    """(seq_id, start, end, n): runs where ``active`` is true."""
    runs = to_segments(df.withColumn("_on", F.coalesce(active, F.lit(False)).cast("int")), "_on")
    return runs.filter("label = 1").select("seq_id", "start", "end", "n")


def remove_small_segments(df: DataFrame, min_len: int, label: str = "label") -> DataFrame:
    """Frames with runs below ``min_len`` taken over by the kept run before; -1 before the first kept run."""
    runs = to_segments(df, label)
    kept = F.last(F.when(F.col("n") >= min_len, F.col("label")), ignorenulls=True).over(Window.partitionBy("seq_id").orderBy("seg_id"))
    return from_segments(runs.withColumn("label", F.coalesce(kept, F.lit(-1).cast(df.schema[label].dataType))))


def joint_segments(df: DataFrame, channels: list[str], min_len: int = 30) -> DataFrame:
    """(seq_id, t, seg_id): segments of any number of channels read together; a null is a value of its own."""
    key = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in channels])
    coded = df.select("seq_id", "t", F.concat(F.lit("="), key).alias("label"))
    return segment_ids(remove_small_segments(coded, min_len) if min_len > 0 else coded).select("seq_id", "t", "seg_id")


def reduce_over_segments(df: DataFrame, *aggregates: Column) -> DataFrame:
    """One row a segment of a table that has seg_id; the frame form is the same aggregates over a window."""
    return df.groupBy("seq_id", "seg_id").agg(*aggregates)


def reduce_with(df: DataFrame, reductions: dict[str, tuple[Callable, list[str]]], *aggregates: Column, most_rows: int = 1_000_000) -> DataFrame:
    """One row a segment: Python reductions beside built-in aggregates.

    A reduction is a callable from the segment's values, one numpy array a column in time order, to a number, given by name
    with its columns (missing values are NaN). Segments are read as a stream of Arrow batches in the order of (seq_id, seg_id, t), so
    the only cost of a segment in Python is the call itself; the built-in aggregates are joined on (seq_id, seg_id). A worker holds a batch and
    one segment; one of more than ``most_rows`` frames fails by name rather than by memory. NaN and None results are null.
    """
    keys = ["seq_id", "seg_id"]
    used = list(dict.fromkeys(c for _, columns in reductions.values() for c in columns))
    at = Window.partitionBy(*keys).orderBy(F.col("t").asc_nulls_last())
    too_long = F.raise_error(F.concat_ws(" ", F.lit("segment too long for a Python reduction:"), *keys)).cast("boolean")
    first = F.when(F.row_number().over(at) <= most_rows, F.row_number().over(at) == 1).otherwise(too_long)
    rows = df.select(*keys, first.alias("_first"), "t", *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(used)])

    def reduced(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        """Whole segments."""
        whole = pa.Table.from_batches(parts).combine_chunks()
        starts = np.flatnonzero(whole.column("_first").to_numpy())
        bounds = list(zip(starts.tolist(), [*starts[1:].tolist(), len(whole)], strict=True))
        out = whole.select(keys).take(pa.array(starts))
        for name, (reduce, columns) in reductions.items():
            values = [np.array(whole.column(f"_v{used.index(c)}").to_numpy()) for c in columns]
            results = [reduce(*[v[i:j] for v in values]) for i, j in bounds]
            out = out.append_column(name, pa.array([None if x is None or np.isnan(x) else float(x) for x in results], pa.float64()))
        return out.combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            begins = np.flatnonzero(batch.column("_first").to_numpy(zero_copy_only=False))
            if len(begins) and (held or begins[-1]):
                yield reduced([*held, batch.slice(0, begins[-1])])
                held = []
            if batch.num_rows:
                held.append(batch.slice(begins[-1]) if len(begins) else batch)
        if held:
            yield reduced(held)

    types = ", ".join([*[f"{k} {df.schema[k].dataType.simpleString()}" for k in keys], *[f"`{name}` double" for name in reductions]])
    out = rows.sortWithinPartitions(*keys, F.col("t").asc_nulls_last()).select(*keys, "_first", *[f"_v{i}" for i in range(len(used))]).mapInArrow(run, types)
    if not aggregates:
        return out
    return reduce_over_segments(df, *aggregates).join(out, keys)


def slice_means(df: DataFrame, active: Column, value: str) -> DataFrame:
    """(seq_id, t, mean): the mean of ``value`` over the active slice a frame lies in, 0 elsewhere."""
    marked = segment_ids(df.withColumn("_on", active.cast("int")), "_on")
    mean = F.avg(value).over(Window.partitionBy("seq_id", "seg_id"))
    return marked.select("seq_id", "t", F.when(F.col("_on") == 1, mean).otherwise(F.lit(0.0)).alias("mean"))


def revise_labels(df: DataFrame, active: Column, value: str, threshold: float = 0.0) -> DataFrame:
    """(seq_id, t, label): 1 on active slices whose mean value exceeds the threshold."""
    return slice_means(df.withColumn("_v", F.col(value)), active, "_v").select("seq_id", "t", (F.col("mean") > threshold).cast("int").alias("label"))


def presegment_scores(df: DataFrame, min_dur: int, score: str = "score") -> DataFrame:
    """(seq_id, seg_id, start, end, class_id, score): mean class scores over runs of frames with a positive score, longer than ``min_dur``."""
    runs = active_slices(df, F.exists(score, lambda x: x > 0)).filter(F.col("n") > min_dur)
    runs = runs.withColumn("seg_id", F.row_number().over(Window.partitionBy("seq_id").orderBy("start")) - 1)
    frames = df.join(runs.select("seq_id", "seg_id", F.explode(F.sequence("start", "end")).alias("t"), "start", "end"), ["seq_id", "t"])
    flat = frames.select("seq_id", "seg_id", "start", "end", F.posexplode(score).alias("class_id", "s"))
    return flat.groupBy("seq_id", "seg_id", "start", "end", "class_id").agg(F.avg("s").alias("score"))


def nested_segments(df: DataFrame, inner: Column, outer: Column) -> DataFrame:
    """Runs of ``inner`` inside ``outer``."""
    return active_slices(df, inner & outer)


def trim_to_label(df: DataFrame, keep: Column) -> DataFrame:
    """Frames where ``keep`` holds, numbered anew from 0; sequences without one are gone."""
    return df.filter(keep).withColumn("t", F.row_number().over(in_order("t")) - 1)


def remap_labels(df: DataFrame, mapping: DataFrame, label: str = "label") -> DataFrame:
    """Labels replaced by ``mapping`` (old, new), a vocabulary; all keys read the old value."""
    return df.join(mapping, F.col(label) == F.col("old"), "left").withColumn(label, F.coalesce("new", label)).drop("old", "new")


def min_states(df: DataFrame, least: int) -> DataFrame:
    """Rows of sequences that have at least ``least`` rows."""
    return df.join(df.groupBy("seq_id").count().filter(F.col("count") >= least).select("seq_id"), "seq_id", "left_semi")
