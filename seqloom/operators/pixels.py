"""Image tables as grouped aggregates over (seq_id, t, row, col, ...) pixels; segment 0 is background."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FRAME = ["seq_id", "t"]


def segment_features(pixels: DataFrame, *values: str) -> DataFrame:
    """(seq_id, t, segment, n, row, col, top, left, bottom, right, sums): size, centroid, box and sums of the value columns."""
    sums = [F.sum(v).alias(v) for v in values]
    boxes = [F.min("row").alias("top"), F.min("col").alias("left"), F.max("row").alias("bottom"), F.max("col").alias("right")]
    out = pixels.filter("segment <> 0").groupBy(*FRAME, "segment").agg(F.count("*").alias("n"), F.avg("row").alias("_r"), F.avg("col").alias("_c"), *boxes, *sums)
    return out.withColumnsRenamed({"_r": "row", "_c": "col"})


def frame_scores(pixels: DataFrame, table: DataFrame) -> DataFrame:
    """(seq_id, t, score): mean log-ratio of the foreground pixels through their colour cluster (cluster, ratio)."""
    return pixels.filter("segment <> 0").join(table, "cluster").groupBy(*FRAME).agg(F.avg("ratio").alias("score"))


def _kept(pixels: DataFrame, keep: DataFrame) -> DataFrame:
    """Pixels with the kept segments numbered 1, 2, ... and the others in the background."""
    numbers = keep.select(*FRAME, "segment", F.row_number().over(Window.partitionBy(*FRAME).orderBy("segment")).alias("_new"))
    return pixels.join(numbers, [*FRAME, "segment"], "left").withColumn("segment", F.coalesce("_new", F.lit(0))).drop("_new")


def filter_segments(pixels: DataFrame, bad: Column, most_bad: float = 0.9, least: int = 64) -> DataFrame:
    """Segments with too many bad pixels, or too few pixels, go to the background."""
    per = pixels.filter("segment <> 0").groupBy(*FRAME, "segment").agg(F.avg(bad.cast("double")).alias("b"), F.count("*").alias("n"))
    return _kept(pixels, per.filter((F.col("b") <= most_bad) & (F.col("n") >= least)))


def near_camera(depth: str, limit: float = 500) -> Column:
    """Whether a pixel is nearer than the limit."""
    return F.col(depth) < limit


def remove_extreme_segment(pixels: DataFrame, direction: tuple[float, float] = (3, 4)) -> DataFrame:
    """The segment whose centroid reaches farthest along the direction (row, col) goes to the background."""
    reach = F.col("row") * direction[0] + F.col("col") * direction[1]
    far = segment_features(pixels).groupBy(*FRAME).agg(F.max(F.struct(reach, "segment"))["segment"].alias("segment"))
    segments = pixels.filter("segment <> 0").select(*FRAME, "segment").distinct()
    return _kept(pixels, segments.join(far, [*FRAME, "segment"], "left_anti"))


def drop_background_segments(pixels: DataFrame, background: Column) -> DataFrame:
    """Segments of which most pixels are background go to it."""
    per = pixels.filter("segment <> 0").groupBy(*FRAME, "segment").agg(F.avg(background.cast("double")).alias("b"))
    return _kept(pixels, per.filter(F.col("b") <= 0.5))


def background_model(pixels: DataFrame, masked: Column, channels: list[str], limit: float = 0.2) -> DataFrame:
    """Pixels with ``background``: whether their colour lies within ``limit`` of the place's mean over the masked frames."""
    mean = pixels.filter(masked).groupBy("seq_id", "row", "col").agg(*[F.avg(c).alias(f"_{c}") for c in channels])
    gap = reduce(Column.__add__, [F.pow(F.col(c) - F.col(f"_{c}"), 2) for c in channels])
    return pixels.join(mean, ["seq_id", "row", "col"], "left").withColumn("background", F.coalesce(F.sqrt(gap) < limit, F.lit(False))).drop(*[f"_{c}" for c in channels])


def fit_color_model(pixels: DataFrame, k: int, smoothing: float = 1.0, seed: int = 0) -> tuple[object, DataFrame]:
    """A k-means of colours and (cluster, ratio): log of the smoothed foreground over background share of each cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    points = VectorAssembler(inputCols=["r", "g", "b"], outputCol="features").transform(pixels)
    model = KMeans(k=k, seed=seed).fit(points)
    on = (F.col("segment") != 0).cast("long")
    per = model.transform(points).groupBy(F.col("prediction").alias("cluster")).agg(F.sum(on).alias("a"), F.sum(1 - on).alias("z"))
    every = Window.partitionBy(F.lit(1))
    share = lambda c: (F.col(c) + smoothing) / (F.sum(c).over(every) + smoothing * k)
    return model, per.select("cluster", F.log(share("a") / share("z")).alias("ratio"))


def frame_snr(pixels: DataFrame, signal: list[int], noise: list[int]) -> DataFrame:
    """(seq_id, t, snr): pixels in signal clusters over those in noise clusters; null without noise."""
    count = lambda xs: F.sum(F.col("cluster").isin(xs).cast("long"))
    return pixels.groupBy(*FRAME).agg(F.try_divide(count(signal), count(noise)).alias("snr"))


def best_frame(frames: DataFrame, score: str) -> DataFrame:
    """(seq_id, t): the first frame with the highest score."""
    return frames.filter(F.col(score).isNotNull()).groupBy("seq_id").agg((-F.max(F.struct(score, (-F.col("t")).alias("m")))["m"]).alias("t"))


def label_pixels(pixels: DataFrame, centers: list[tuple[float, float, float]]) -> DataFrame:
    """Pixels with ``color``: 1 + the nearest colour centre, 0 in the background."""
    gap = lambda c: F.pow(F.col("r") - c[0], 2) + F.pow(F.col("g") - c[1], 2) + F.pow(F.col("b") - c[2], 2)
    near = F.array_min(F.array(*[F.struct(gap(c).alias("d"), F.lit(i + 1).alias("i")) for i, c in enumerate(centers)]))["i"]
    return pixels.withColumn("color", F.when(F.col("segment") == 0, 0).otherwise(near))
