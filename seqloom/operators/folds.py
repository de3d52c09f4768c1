"""Cross-validation folds and experiment tables."""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.ranks import quantiles
from seqloom.functions.tables import numbered


def make_folds(ids: DataFrame, n: int, val_share: float, draw: Column, draw_val: Column, key: str = "seq_id") -> DataFrame:
    """(fold, split, key): each fold tests its n-tile of the ids by ``draw``; of the rest the first share by ``draw_val`` validates.

    Ids are numbered by range twice, by draw for the tiles and by ``draw_val`` within the rest of each fold, so no task sees them all.
    """
    drawn = numbered(ids.select(key).distinct(), "_i", draw, key)
    total = drawn.count()
    small, longer = total // n, total % n  # the first tiles have one id more
    tile = F.when(F.col("_i") < longer * (small + 1), F.floor(F.col("_i") / (small + 1))).otherwise(longer + F.floor((F.col("_i") - longer * (small + 1)) / max(small, 1)))
    folds = drawn.select(key, tile.cast("int").alias("_tile"), draw_val.alias("_v")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    test = F.col("_tile") == F.col("fold")
    rest = numbered(folds.filter(~test), "_r", "fold", "_v", key)
    first = rest.groupBy("fold").agg(F.min("_r").alias("_first"), F.count("*").alias("_n"))  # one row a fold
    share = F.col("_r") - F.col("_first") < F.floor(F.col("_n") * val_share)
    learnt = rest.join(F.broadcast(first), "fold").select("fold", F.when(share, "val").otherwise("train").alias("split"), key)
    return learnt.unionByName(folds.filter(test).select("fold", F.lit("test").alias("split"), key))


def make_group_folds(items: DataFrame, group: str, n: int, val_share: float, draw: Column, draw_val: Column) -> DataFrame:
    """Folds in which no group spans two splits."""
    folds = make_folds(items, n, val_share, draw, draw_val, group)
    return items.select("seq_id", group).distinct().join(folds, group).select("fold", "split", "seq_id")


def incomplete_folds(folds: DataFrame, ids: DataFrame) -> DataFrame:
    """(fold, seq_id) of sequences that a predefined fold leaves out."""
    wanted = ids.select("seq_id").distinct().join(F.broadcast(folds.select("fold").distinct().groupBy().agg(F.collect_set("fold").alias("_f"))), how="inner")  # one row
    return wanted.select(F.explode("_f").alias("fold"), "seq_id").join(folds, ["fold", "seq_id"], "left_anti")


def split_clips(clips: DataFrame, folds: DataFrame) -> DataFrame:
    """Clips with their fold and split; write with ``partitionBy("fold", "split")``."""
    return clips.join(folds, "seq_id")


def summarize_results(results: DataFrame, *by: str) -> DataFrame:
    """(by, metric, mean, std, n): sample deviation over rows."""
    return results.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n"))


def summarize_cube(results: DataFrame, *by: str) -> DataFrame:
    """The same for every combination of the sweep columns, null meaning all."""
    return results.cube(*by).agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def plain_interval(results: DataFrame, confidence: float, few: int = 10_000) -> DataFrame:
    """(metric, low, mean, high): quantiles of the values themselves, by exact selection; no metric's values are gathered or sorted."""
    low = (1 - confidence) / 2
    means = results.groupBy("metric").agg(F.avg("value").alias("mean"))
    return means.join(quantiles(results, "value", {"low": low, "high": 1 - low}, "metric", few=few), "metric", "left").select("metric", "low", "mean", "high")


def bootstrap_interval(results: DataFrame, replicates: int, confidence: float, seed: int = 0) -> DataFrame:
    """(metric, low, mean, high): quantiles of the mean over replicates that draw whole sequences with replacement.

    Every sequence enters a replicate a Poisson(1) number of times, drawn by hash, so replicates are sums over all sequences
    and no sample is gathered anywhere. A sequence's values are summed before they are multiplied by the replicates; one
    digest of ``seed:seq_id:metric:block`` gives the draws of four of them, eight hex digits each. ``replicates`` is what the last quantiles hold.
    """
    sums = results.filter("value is not null").groupBy("seq_id", "metric").agg(F.sum("value").alias("_s"), F.count("*").alias("_n"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("seq_id").cast("string"), "metric", F.col("_block").cast("string")).cast("binary"))
    blocks = sums.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 4)))).withColumn("_d", digest)
    draws = blocks.select("metric", "_s", "_n", "_block", "_d", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("_i"))
    draws = draws.withColumn("_r", F.col("_block") * 4 + F.col("_i")).filter(F.col("_r") < replicates)
    u = F.conv(F.substring("_d", F.col("_i") * 8 + 1, F.lit(8)), 16, 10).cast("long")
    times = sum((F.when(u >= edge, 1).otherwise(0) for edge in poisson_edges()), F.lit(0))
    drawn = draws.withColumn("_k", times).groupBy("metric", "_r").agg(F.try_divide(F.sum(F.col("_k") * F.col("_s")), F.sum(F.col("_k") * F.col("_n"))).alias("m"))
    low = (1 - confidence) / 2
    return drawn.groupBy("metric").agg(F.percentile("m", low).alias("low"), F.avg("m").alias("mean"), F.percentile("m", 1 - low).alias("high"))


def poisson_edges(most: int = 8) -> list[int]:
    """Where the cumulative Poisson(1) distribution lies on 32-bit draws: a draw of at least k of them is a count of k."""
    out, p, total = [], exp(-1), 0.0
    for k in range(1, most + 1):
        total += p
        out.append(round(total * 2**32))
        p /= k
    return out


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, *by: str) -> DataFrame:
    """(by, bucket, n): equal bins from 1; 0 and bins + 1 hold what lies outside."""
    bucket = F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins))
    return df.groupBy(*by, bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def linear_fit(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """(by, slope, intercept) of y over x."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def cross_corpus_fold(train: DataFrame, test: DataFrame) -> DataFrame:
    """One fold: all sequences of one corpus train, all of the other test."""
    one = train.select("seq_id").distinct().withColumn("split", F.lit("train"))
    return one.unionByName(test.select("seq_id").distinct().withColumn("split", F.lit("test"))).select(F.lit(0).alias("fold"), "split", "seq_id")
