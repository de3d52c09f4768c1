"""Registered queries: signal features (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import signals as S
from seqloom.plans.inputs import ANN, FRAMES, PAIRS, SIGNAL, annotations, frames, signal, with_
from seqloom.plans.registry import query

SIG = with_(FRAMES, SIGNAL)
PAIR = with_(FRAMES, SIGNAL, PAIRS)


@query("f1_magnitude", "SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax), 6) AS size FROM lineitem")
def f1(s, d):
    from seqloom.plans.inputs import table

    x = table(s, d, "lineitem")
    return x.select("l_orderkey", "l_linenumber", F.round(S.magnitude(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")), 6).alias("size"))


@query("f2_resting", SIG + "SELECT seq_id, device, stddev_samp(value) < 45 AS resting FROM sig GROUP BY 1, 2")
def f2(s, d):
    return S.device_is_resting(signal(s, d), 45)


@query(
    "f2_resting_3d",
    SIG + """, c AS (SELECT seq_id, device, covar_samp(x, x) AS xx, covar_samp(y, y) AS yy, covar_samp(z, z) AS zz, covar_samp(x, y) AS xy, covar_samp(x, z) AS xz, covar_samp(y, z) AS yz FROM (SELECT seq_id, device, value AS x, CAST(k AS DOUBLE) AS y, CAST(t AS DOUBLE) AS z FROM sig) GROUP BY 1, 2)
 SELECT seq_id, device, sqrt(greatest(xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz), 0)) < 4000 AS resting FROM c""",
)
def f2b(s, d):
    x = signal(s, d).select("seq_id", "device", F.col("value").alias("x"), F.col("k").cast("double").alias("y"), F.col("t").cast("double").alias("z"))
    return S.device_is_resting_3d(x, 4000)


REST = "rest AS (SELECT seq_id, device, stddev_samp(value) < 45 AS resting FROM sig GROUP BY 1, 2)"


@query("f3_center_signals", with_(FRAMES, SIGNAL, REST) + "SELECT seq_id, device, t, round(value - avg(CASE WHEN NOT resting THEN value END) OVER (PARTITION BY seq_id, t), 6) AS value FROM sig JOIN rest USING (seq_id, device)")
def f3(s, d):
    x = signal(s, d)
    return S.center_signals(x, S.device_is_resting(x, 45)).select("seq_id", "device", "t", F.round("value", 6).alias("value"))


@query("f4_pair_diff", PAIR + "SELECT seq_id, t, d1, d2, round((100 - abs(a - b)) * (a / 200) * (b / 200), 6) AS diff FROM pairs")
def f4(s, d):
    return S.pair_diff(S.device_pairs(signal(s, d))).select("seq_id", "t", "d1", "d2", F.round("diff", 6).alias("diff"))


@query("f5_pair_products", PAIR + "SELECT seq_id, t, d1, d2, round(a * b, 6) AS product FROM pairs")
def f5(s, d):
    return S.pair_products(S.device_pairs(signal(s, d))).select("seq_id", "t", "d1", "d2", F.round("product", 6).alias("product"))


@query("f6_pair_features", PAIR + "SELECT seq_id, t, d1, d2, a, b, round(a - b, 6) AS difference FROM pairs")
def f6(s, d):
    return S.pair_features(S.device_pairs(signal(s, d))).withColumn("difference", F.round("difference", 6))


@query(
    "f7_component_residual",
    SIG + ", c AS (SELECT *, device // 2 AS component FROM sig), m AS (SELECT *, count(*) OVER w AS n, sum(value) OVER w AS total FROM c WINDOW w AS (PARTITION BY seq_id, t, component)) SELECT seq_id, device, t, round(value - CASE WHEN n > 1 THEN (total - value) / (n - 1) ELSE 0 END, 6) AS residual FROM m",
)
def f7(s, d):
    x = signal(s, d)
    comps = x.select("seq_id", "device").distinct().withColumn("component", F.expr("device div 2"))
    return S.component_residual(x, comps).select("seq_id", "device", "t", F.round("residual", 6).alias("residual"))


@query("f8_stationary_bias", SIG + "SELECT seq_id, device, t, round(value - coalesce(avg(CASE WHEN k < 40 THEN value END) OVER (PARTITION BY seq_id, device), 0), 6) AS value FROM sig")
def f8(s, d):
    return S.remove_stationary_bias(signal(s, d), F.col("k"), 40).select("seq_id", "device", "t", F.round("value", 6).alias("value"))


@query("f9_gyro_angle", SIG + ", st AS (SELECT *, value * coalesce(us / 1e6 - lag(us / 1e6) OVER (PARTITION BY seq_id, device ORDER BY t), 0) AS step FROM sig) SELECT seq_id, device, t, round(sum(step) OVER (PARTITION BY seq_id, device ORDER BY t) / 1e6, 4) AS angle FROM st")
def f9(s, d):
    x = S.gyro_angle(signal(s, d).withColumn("sec", F.col("us") / 1e6), "value", "sec")
    return x.select("seq_id", "device", "t", F.round(F.col("angle") / 1e6, 4).alias("angle"))


TURNS = "WITH RECURSIVE " + FRAMES + ", " + SIGNAL + """, r AS (SELECT seq_id, device, t, coalesce(CAST(t AS DOUBLE) * 0.01 - lag(CAST(t AS DOUBLE) * 0.01) OVER w, 0) AS dt, value / 1000 AS gx, k / 1000 AS gy, k / 100 AS ay, CAST(9.81 AS DOUBLE) AS az, coalesce(abs(k / 100 - lag(k / 100) OVER w) < 0.005, false) AS still FROM sig WINDOW w AS (PARTITION BY seq_id, device ORDER BY t)),
 h AS (SELECT *, 0.5 * dt * gx AS hx, 0.5 * dt * gy AS hy FROM r),
 q AS (SELECT seq_id, device, t, CAST(1 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS z FROM h WHERE t = 0
 UNION ALL SELECT seq_id, device, t, w / n, x / n, y / n, z / n FROM (SELECT *, sqrt(w * w + x * x + y * y + z * z) AS n FROM (SELECT h.seq_id, h.device, h.t, q.w - q.x * hx - q.y * hy AS w, q.w * hx + q.x - q.z * hy AS x, q.w * hy + q.y + q.z * hx AS y, q.z + q.x * hy - q.y * hx AS z FROM q JOIN h ON h.seq_id = q.seq_id AND h.device = q.device AND h.t = q.t + 1) a) b),
 i AS (SELECT h.*, w, x, y, z, y * az - z * ay AS i1, w * ay - x * az AS i2, x * ay + w * az AS i3 FROM h JOIN q USING (seq_id, device, t)),
 g AS (SELECT *, count(*) FILTER (still) OVER (PARTITION BY seq_id, device ORDER BY t) AS seg, 2 * (y * i3 - z * i2) AS wx, ay + 2 * (z * i1 - x * i3) AS wy, az - 9.81 + 2 * (x * i2 - y * i1) AS wz FROM i),
 v AS (SELECT *, sum(CASE WHEN still THEN 0 ELSE wx * dt END) OVER s AS vx, sum(CASE WHEN still THEN 0 ELSE wy * dt END) OVER s AS vy, sum(CASE WHEN still THEN 0 ELSE wz * dt END) OVER s AS vz FROM g WINDOW s AS (PARTITION BY seq_id, device, seg ORDER BY t)),
 p AS (SELECT *, sum(vx * dt) OVER s AS px, sum(vy * dt) OVER s AS py, sum(vz * dt) OVER s AS pz FROM v WINDOW s AS (PARTITION BY seq_id, device ORDER BY t))
 SELECT seq_id, device, t, """ + ", ".join(f"round({a}, 6) + 0 AS {b}" for a, b in zip(["w", "x", "y", "z", "vx", "vy", "vz", "px", "py", "pz"], ["qw", "qx", "qy", "qz", "vx", "vy", "vz", "px", "py", "pz"], strict=True)) + " FROM p"


@query("f9_orientation_track", TURNS)
def f9b(s, d):
    x = signal(s, d)
    small = [(F.col("value") / 1000).alias("gx"), (F.col("k") / 1000).alias("gy"), F.lit(0.0).alias("gz"), F.lit(0.0).alias("ax"), (F.col("k") / 100).alias("ay"), F.lit(9.81).alias("az")]
    track = S.orientation_track(x.select("seq_id", "device", "t", (F.col("t") * 0.01).alias("s"), *small))
    return track.select("seq_id", "device", "t", *[F.round(c, 6).alias(c) for c in track.columns[3:]])


PLACES = "pl AS (SELECT seq_id, t, device AS part, CASE WHEN k > 10 THEN value END AS x, CAST(k AS DOUBLE) AS y, CAST(device AS DOUBLE) AS z FROM sig)"


@query("f10_pair_distance", with_(FRAMES, SIGNAL, PLACES) + "SELECT a.seq_id, a.t, a.part AS p1, b.part AS p2, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) AS distance FROM pl a JOIN pl b ON a.seq_id = b.seq_id AND a.t = b.t AND a.part > b.part")
def f10(s, d):
    pl = signal(s, d).select("seq_id", "t", F.col("device").alias("part"), F.when(F.col("k") > 10, F.col("value")).alias("x"), F.col("k").cast("double").alias("y"), F.col("device").cast("double").alias("z"))
    return S.pair_distance(pl).withColumn("distance", F.round("distance", 6))


@query("f11_feasible_pairs", with_(ANN) + ", h AS (SELECT DISTINCT 'p' || part1 || '_hole_' || part2 AS hole, 'p' || part1 AS part FROM ann) SELECT a.hole AS hole1, b.hole AS hole2 FROM h a JOIN h b ON a.hole > b.hole AND a.part <> b.part")
def f11(s, d):
    return S.feasible_pairs(annotations(s, d).select(F.concat(F.lit("p"), "part1", F.lit("_hole_"), "part2").alias("hole")).distinct())


POSES = """po AS (SELECT seq_id, t, device AS part, value AS x, CAST(k AS DOUBLE) AS y, 1.0 * device AS z, cos(k) AS qw, sin(k) AS qx, 0.0 AS qy, 0.0 AS qz FROM sig)"""


def _poses(s, d):
    return signal(s, d).select("seq_id", "t", F.col("device").alias("part"), F.col("value").alias("x"), F.col("k").cast("double").alias("y"), F.col("device").cast("double").alias("z"), F.cos("k").alias("qw"), F.sin("k").alias("qx"), F.lit(0.0).alias("qy"), F.lit(0.0).alias("qz"))


@query(
    "f12_average_pose",
    with_(FRAMES, SIGNAL, POSES) + """, f AS (SELECT *, first_value(qw) OVER w AS fw, first_value(qx) OVER w AS fx FROM po WINDOW w AS (PARTITION BY seq_id, t ORDER BY part)),
 m AS (SELECT seq_id, t, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(CASE WHEN qw * fw + qx * fx < 0 THEN -qw ELSE qw END) AS w, avg(CASE WHEN qw * fw + qx * fx < 0 THEN -qx ELSE qx END) AS v FROM f GROUP BY 1, 2)
 SELECT seq_id, t, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z, round(v / sqrt(v * v + w * w), 5) AS qx, round(w / sqrt(v * v + w * w), 5) AS qw FROM m""",
)
def f12(s, d):
    p = S.average_pose(_poses(s, d), ["seq_id", "t"], "part")
    return p.select("seq_id", "t", *[F.round(c, 5).alias(c) for c in ("x", "y", "z", "qx", "qw")])


@query(
    "f13_child_poses",
    with_(FRAMES, SIGNAL, POSES) + """SELECT seq_id, t, 'c' || part AS part, round(x + 1, 5) AS x, round(y + 2 * (2 * qw * qw - 1) - 3 * (2 * qw * qx), 5) AS y, round(z + 2 * (2 * qw * qx) + 3 * (2 * qw * qw - 1), 5) AS z, round(qx, 5) AS qx, round(qw, 5) AS qw FROM po""",
)
def f13(s, d):
    p = _poses(s, d)
    joints = p.select(F.col("part").alias("parent")).distinct().select("parent", F.concat(F.lit("c"), "parent").alias("child"), F.lit(1.0).alias("jx"), F.lit(2.0).alias("jy"), F.lit(3.0).alias("jz"), F.lit(0.0).alias("jqx"), F.lit(0.0).alias("jqy"), F.lit(0.0).alias("jqz"), F.lit(1.0).alias("jqw"))
    return S.child_poses(p, joints).select("seq_id", "t", "part", *[F.round(c, 5).alias(c) for c in ("x", "y", "z", "qx", "qw")])


@query("f14_camera_frames", with_(FRAMES) + "SELECT seq_id, code AS part, t // 4 AS t FROM frames GROUP BY 1, 2, 3 HAVING count(DISTINCT k // 50) > 1")
def f14(s, d):
    f = frames(s, d)
    return S.check_camera_frames(f.select("seq_id", F.col("code").alias("part"), F.expr("t div 4").alias("t"), F.expr("k div 50").alias("frame")))


HANDS = "hands AS (SELECT seq_id, t, CASE WHEN k % 7 > 0 THEN score END AS x1, CASE WHEN k % 7 > 0 THEN 1.0 * k END AS y1, CASE WHEN k % 5 > 0 THEN score / 2 END AS x2, CASE WHEN k % 5 > 0 THEN 1.0 * ((k * 37) % 100) END AS y2 FROM frames)"


def _hands(s, d, gaps=True):
    k = F.col("k")
    one, two = (k % 7 > 0, k % 5 > 0) if gaps else (F.lit(True), F.lit(True))
    return frames(s, d).select("seq_id", "t", F.when(one, F.col("score")).alias("x1"), F.when(one, k.cast("double")).alias("y1"), F.when(two, F.col("score") / 2).alias("x2"), F.when(two, ((k * 37) % 100).cast("double")).alias("y2"))


@query("f15_reaching_hand", with_(FRAMES, HANDS) + "SELECT seq_id, t, CASE WHEN y1 > 50 THEN x1 WHEN y2 > 50 THEN x2 END AS hx, CASE WHEN y1 > 50 THEN y1 WHEN y2 > 50 THEN y2 END AS hy, x1 IS NULL OR x2 IS NULL AS missing FROM hands")
def f15(s, d):
    return S.reaching_hand(_hands(s, d), 50).select("seq_id", "t", "hx", "hy", "missing")


@query("f16_center_with_flag", with_(FRAMES, HANDS) + "SELECT seq_id, t, round(coalesce(x1 - avg(x1) OVER (PARTITION BY seq_id), 0), 6) AS centered, CAST(x1 IS NULL AS INTEGER) AS is_missing FROM hands")
def f16(s, d):
    return S.center_with_flag(_hands(s, d), "x1").select("seq_id", "t", F.round("centered", 6).alias("centered"), "is_missing")


@query(
    "f17_impute_mean",
    with_(FRAMES, HANDS) + ", m AS (SELECT seq_id, (coalesce(sum(x1), 0) + coalesce(sum(y1), 0) + coalesce(sum(x2), 0) + coalesce(sum(y2), 0)) / (count(x1) + count(y1) + count(x2) + count(y2)) AS m FROM hands GROUP BY 1) SELECT seq_id, t, round(coalesce(x1, m), 5) AS x1, round(coalesce(y1, m), 5) AS y1, round(coalesce(x2, m), 5) AS x2, round(coalesce(y2, m), 5) AS y2 FROM hands JOIN m USING (seq_id)",
)
def f17(s, d):
    c = ["x1", "y1", "x2", "y2"]
    return S.impute_mean(_hands(s, d), c).select("seq_id", "t", *[F.round(x, 5).alias(x) for x in c])


@query(
    "f18_track_pairs",
    with_(FRAMES) + """, h AS (SELECT seq_id, t, score AS x1, CAST(k AS DOUBLE) AS y1, score / 2 AS x2, CAST((k * 37) % 100 AS DOUBLE) AS y2 FROM frames), p AS (SELECT *, lag(x1) OVER w AS a, lag(y1) OVER w AS b, lag(x2) OVER w AS c, lag(y2) OVER w AS e FROM h WINDOW w AS (PARTITION BY seq_id ORDER BY t)),
 f AS (SELECT *, CASE WHEN sqrt((x1 - c) ** 2 + (y1 - e) ** 2) + sqrt((x2 - a) ** 2 + (y2 - b) ** 2) < sqrt((x1 - a) ** 2 + (y1 - b) ** 2) + sqrt((x2 - c) ** 2 + (y2 - e) ** 2) THEN 1 ELSE 0 END AS f FROM p), o AS (SELECT *, sum(f) OVER (PARTITION BY seq_id ORDER BY t) % 2 = 1 AS o FROM f)
 SELECT seq_id, t, CASE WHEN o THEN x2 ELSE x1 END AS x1, CASE WHEN o THEN y2 ELSE y1 END AS y1, CASE WHEN o THEN x1 ELSE x2 END AS x2, CASE WHEN o THEN y1 ELSE y2 END AS y2 FROM o""",
)
def f18(s, d):
    return S.track_pairs(_hands(s, d, gaps=False))


GAP = "coalesce(sqrt((x{0} - {1}x) ** 2 + (y{0} - {1}y) ** 2), 0)"
TRACK = "WITH RECURSIVE " + FRAMES + ", " + HANDS + """, w AS (SELECT DISTINCT seq_id, -1 AS t, CAST(NULL AS DOUBLE) AS px, CAST(NULL AS DOUBLE) AS py, CAST(NULL AS DOUBLE) AS qx, CAST(NULL AS DOUBLE) AS qy FROM hands
 UNION ALL SELECT seq_id, t, CASE WHEN f THEN coalesce(x2, px) ELSE coalesce(x1, px) END, CASE WHEN f THEN coalesce(y2, py) ELSE coalesce(y1, py) END, CASE WHEN f THEN coalesce(x1, qx) ELSE coalesce(x2, qx) END, CASE WHEN f THEN coalesce(y1, qy) ELSE coalesce(y2, qy) END
 FROM (SELECT h.*, px, py, qx, qy, """ + f"{GAP.format(1, 'q')} + {GAP.format(2, 'p')} < {GAP.format(1, 'p')} + {GAP.format(2, 'q')}" + """ AS f FROM w JOIN hands h ON h.seq_id = w.seq_id AND h.t = w.t + 1) z)
 SELECT seq_id, t, px AS x1, py AS y1, qx AS x2, qy AS y2 FROM w WHERE t >= 0"""


@query("f18_track_pairs_with_gaps", TRACK)
def f18b(s, d):
    return S.track_pairs_with_gaps(_hands(s, d))


@query(
    "f19_activity_score",
    "WITH x AS (SELECT vec_id // 200 AS seq_id, CAST((vec_id % 200) // 4 AS INTEGER) AS t, CAST(embedding[3] AS DOUBLE) AS v, label FROM embeddings), m AS (SELECT seq_id, t, max(v) AS v, max(label = 2) AS active FROM x GROUP BY 1, 2) SELECT seq_id, t, round(v - avg(v) OVER (PARTITION BY seq_id), 6) AS score, active FROM m",
)
def f19(s, d):
    from seqloom.plans.inputs import table

    e = table(s, d, "embeddings")
    x = e.select(F.expr("vec_id div 200").alias("seq_id"), F.expr("cast((vec_id % 200) div 4 AS int)").alias("t"), F.transform("embedding", lambda v: v.cast("double")).alias("score"), "label")
    return S.activity_score(x).withColumn("score", F.round("score", 6))
