"""Tables in the layouts that other programs read, and how they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.segments import to_segments


def clip_labels(clips: DataFrame, prefix: str = "seq-") -> DataFrame:
    """Clips as (video_name, start_index, end_index, label_id)."""
    return clips.select(F.concat(F.lit(prefix), F.col("seq_id").cast("string")).alias("video_name"), F.col("start").alias("start_index"), F.col("end").alias("end_index"), F.col("label").alias("label_id"))


def segment_labels(frames: DataFrame, label: str = "label", vocab: DataFrame | None = None) -> DataFrame:
    """Segments as (seq_id, start, end, label); with ``vocab`` (id, name) by name."""
    runs = to_segments(frames, label).select("seq_id", "start", "end", "label")
    if vocab is None:
        return runs
    return runs.join(vocab.select(F.col("id").alias("label"), "name"), "label").select("seq_id", "start", "end", F.col("name").alias("label"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append_results(results: DataFrame, path: str) -> None:
    """Add metric rows (experiment, fold, seq_id, metric, value, params) to a results table, a folder an experiment."""
    results.write.mode("append").partitionBy("experiment").parquet(path)
