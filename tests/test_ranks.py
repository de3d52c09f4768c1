"""Exact selection against sorting."""

import numpy as np
import pytest

from seqloom.functions import ranks
from seqloom.operators import counts, folds


@pytest.mark.parametrize("few", [5, 10_000])
def test_order_statistics(spark, few):
    rng = np.random.default_rng(3)
    groups = {"ties": rng.integers(0, 4, 700).astype(float), "wide": np.exp(rng.normal(size=900) * 80), "one": np.array([7.0]), "same": np.full(300, -2.5), "ends": np.array([np.inf, -np.inf, 0.0, 1.0] * 20)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("ties", None), ("wide", float("nan")), ("none", None)]
    values = spark.createDataFrame(rows, "g string, v double").repartition(7)
    asked = [(g, int(r)) for g, vs in groups.items() for r in {0, len(vs) // 3, len(vs) // 2, len(vs) - 1, len(vs)}] + [("none", 0), ("ties", -1)]
    out = ranks.order_statistics(values, spark.createDataFrame(asked, "g string, rank long"), "v", "g", few=few).collect()
    want = {(g, r): (float(np.sort(groups[g])[r]) if g in groups and 0 <= r < len(groups[g]) else None) for g, r in asked}
    assert {(r.g, r.rank): r.v for r in out} == want


@pytest.mark.parametrize("few", [4, 10_000])
def test_quantiles_interpolate(spark, few):
    vs = np.random.default_rng(4).normal(size=501)
    df = spark.createDataFrame([("a", "x", float(v)) for v in vs] + [("b", "x", None)], "seq_id string, metric string, value double")
    r = folds.plain_interval(df, 0.68, few).first()
    assert np.allclose([r.low, r.mean, r.high], [np.quantile(vs, 0.16), vs.mean(), np.quantile(vs, 0.84)])
    assert ranks.quantiles(df.filter("value is null"), "value", {"low": 0.5}, "metric").count() == 0


@pytest.mark.parametrize("few", [3, 10_000])
def test_trim_as_by_percent_rank(spark, few):
    rng = np.random.default_rng(5)
    rows = [(c, float(x), float(x), float(s)) for c, n in ((0, 400), (1, 41), (2, 2), (3, 1)) for x, s in zip(rng.normal(size=n), rng.integers(0, 30, n), strict=True)]
    rows += [(0, 1.0, 1.0, None), (4, 1.0, 2.0, None), (4, 1.0, 2.0, None)]
    points = spark.createDataFrame(rows, "cls int, x double, y double, score double")
    for ratio in (0.0, 0.05, 0.5, 1.0):
        points.createOrReplaceTempView("trimmed")
        want = spark.sql(f"SELECT cls, count(*) AS n, avg(x) AS mx FROM (SELECT *, percent_rank() OVER (PARTITION BY cls ORDER BY score) AS r FROM trimmed) WHERE r >= {ratio} GROUP BY cls").collect()
        ours = counts.trim_and_refit(points, ratio, few).select("cls", "n", "mx").collect()
        key = lambda rs: sorted((r.cls, r.n, round(r.mx, 9)) for r in rs)
        assert key(ours) == key(want)


def test_no_class_is_sorted(spark):
    points = spark.createDataFrame([(0, 1.0, 2.0, float(i)) for i in range(50)], "cls int, x double, y double, score double")
    plan = counts.trim_and_refit(points)._jdf.queryExecution().toString()
    assert "Window" not in plan
