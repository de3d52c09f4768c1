"""Registered queries: scores (I), folds (J), metrics (K), count models (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import arrays as X
from seqloom.operators import counts as H
from seqloom.operators import folds as J
from seqloom.operators import metrics as K
from seqloom.operators import scores as I
from seqloom.operators.segments import to_segments
from seqloom.plans.inputs import ANN, FRAMES, PARTS, SCORES, annotations, frames, part_actions, scores, table, with_
from seqloom.plans.intervals import runs_of
from seqloom.plans.registry import query

SC = with_(SCORES)


def _long(expr: str, head: str = SC, src: str = "scores") -> str:
    return head + f"SELECT seq_id, t, CAST(unnest(range(0, 10)) AS INTEGER) AS class_id, round(unnest({expr}), 5) AS s FROM {src}"


def _flat(df):
    return I.long_form(df).withColumn("s", F.round("s", 5))


LSE = "(SELECT *, ln(list_sum(list_transform(score, lambda x: exp(x)))) AS z FROM scores)"


@query("i1_log_softmax", _long("list_transform(score, lambda x: x - z)", src=LSE))
def i1(s, d):
    return _flat(scores(s, d).withColumn("score", X.log_softmax(F.col("score"))))


@query("i1_softmax", _long("list_transform(score, lambda x: exp(x - z))", src=LSE))
def i1b(s, d):
    return _flat(scores(s, d).withColumn("score", X.softmax(F.col("score"))))


@query("i1_sigmoid", _long("list_transform(score, lambda x: 1 / (1 + exp(-x)))"))
def i1c(s, d):
    return _flat(scores(s, d).withColumn("score", X.sigmoid(F.col("score"))))


@query("i2_signed_probs", _long("list_transform(score, lambda x: 2 * x - 1)"))
def i2(s, d):
    return _flat(scores(s, d).withColumn("score", X.signed_probs(F.col("score"))))


@query("i3_normalize_by_count", _long("list_transform(score, lambda x: x / (t + 1))"))
def i3(s, d):
    x = scores(s, d)
    return _flat(I.normalize_scores(x, x.select("seq_id", "t", (F.col("t") + 1).alias("n"))))


@query("i4_standardize", SC + ", l AS (SELECT seq_id, t, CAST(unnest(range(0, 10)) AS INTEGER) AS class_id, unnest(score) AS s FROM scores) SELECT seq_id, t, class_id, round((s - avg(s) OVER (PARTITION BY class_id)) / stddev_pop(s) OVER (PARTITION BY class_id), 5) AS s FROM l")
def i4(s, d):
    x = scores(s, d)
    return I.standardize(x, I.fit_moments(x)).withColumn("s", F.round("s", 5))


@query("i5_argmax", SC + "SELECT seq_id, t, CAST(list_position(score, list_max(score)) - 1 AS INTEGER) AS pred FROM scores")
def i5(s, d):
    return scores(s, d).select("seq_id", "t", X.argmax(F.col("score")).alias("pred"))


@query("i6_suppress_nonmax", _long("list_transform(score, lambda x, i: CASE WHEN i = list_position(score, list_max(score)) THEN x ELSE 0 END)"))
def i6(s, d):
    return _flat(scores(s, d).withColumn("score", X.suppress_nonmax(F.col("score"))))


@query("i7_assign_to_mode", _long("CASE WHEN list_position(score, list_max(score)) - 1 IN (1, 3, 5) THEN list_transform(score, lambda x, i: CASE WHEN i = list_position(score, list_max(score)) THEN 1.0 ELSE 0.0 END) ELSE score END"))
def i7(s, d):
    return _flat(scores(s, d).withColumn("score", X.assign_to_mode(F.col("score"), [1, 3, 5])))


@query("i8_prune", SC + ", l AS (SELECT seq_id, t, CAST(unnest(range(0, 10)) AS INTEGER) AS class_id, unnest(score) AS s FROM scores) SELECT seq_id, t, class_id, s FROM (SELECT *, dense_rank() OVER (PARTITION BY seq_id, t ORDER BY s DESC) AS r FROM l) WHERE r <= 3")
def i8(s, d):
    return I.long_form(scores(s, d).withColumn("score", X.prune(F.col("score"), 2))).filter(F.col("s") > float("-inf"))


@query("i9_top_k", SC + ", l AS (SELECT seq_id, t, CAST(unnest(range(0, 10)) AS INTEGER) AS class_id, unnest(score) AS s FROM scores) SELECT * FROM (SELECT seq_id, t, CAST(row_number() OVER (PARTITION BY seq_id, t ORDER BY s DESC, class_id) AS INTEGER) AS rank, class_id, s FROM l) WHERE rank <= 3")
def i9(s, d):
    return I.top_k(scores(s, d), 3).select("seq_id", "t", "rank", "class_id", "s")


@query("i10_beam", SC + "SELECT seq_id, t, len(list_filter(score, lambda x: x >= list_max(score) - 0.5)) AS n FROM scores")
def i10(s, d):
    return scores(s, d).select("seq_id", "t", F.size(F.filter(X.beam(F.col("score"), -0.5), lambda x: x)).cast("long").alias("n"))


@query("i11_fuse_scores", _long("list_transform(list_zip(score, list_reverse(score)), lambda x: x[1] + x[2])"))
def i11(s, d):
    x = scores(s, d)
    return _flat(I.fuse_scores(x, x.withColumn("score", F.reverse("score"))))


@query("i12_concat_features", SC + "SELECT seq_id, t, CAST(unnest(range(0, 20)) AS INTEGER) AS class_id, round(unnest(list_concat(score, list_transform(score, lambda x: x * 2))), 5) AS s FROM scores")
def i12(s, d):
    x = scores(s, d)
    return _flat(I.concat_features(x, x.withColumn("score", F.transform("score", lambda y: y * 2))))


@query(
    "i13_pair_scores",
    SC + ", l AS (SELECT seq_id, t, CAST(unnest(range(0, 10)) AS INTEGER) AS c, unnest(score) AS s FROM scores) SELECT a.seq_id, a.t, arg_min(a.c, struct_pack(s := -(a.s + b.s), x := a.c, y := b.c)) AS action, arg_min(b.c, struct_pack(s := -(a.s + b.s), x := a.c, y := b.c)) AS part, round(max(a.s + b.s), 5) AS s FROM l a JOIN l b ON a.seq_id = b.seq_id AND a.t = b.t AND b.c IN (a.c + 1, a.c + 2) GROUP BY 1, 2",
)
def i13(s, d):
    x = scores(s, d)
    seen = s.range(10).select(F.col("id").cast("int").alias("action"), F.explode(F.array((F.col("id") + 1).cast("int"), (F.col("id") + 2).cast("int"))).alias("part")).filter("part < 10")
    return I.pair_scores(x, x, seen).withColumn("s", F.round("s", 5))


@query(
    "i14_signature_scores",
    SC + ", p AS (SELECT seq_id, t, [list_sum(list_transform(score, lambda x, i: CASE WHEN i % 2 = 1 THEN x ELSE -x END)), list_sum(list_transform(score, lambda x, i: CASE WHEN i <= 5 THEN x ELSE -x END)), list_sum(score)] AS q FROM scores) SELECT seq_id, t, CAST(unnest(range(0, 3)) AS INTEGER) AS class_id, round(unnest(list_transform(q, lambda x: x - ln(list_sum(list_transform(q, lambda y: exp(y)))))), 5) AS s FROM p",
)
def i14(s, d):
    sig = [[1 if i % 2 == 0 else -1 for i in range(10)], [1 if i < 5 else -1 for i in range(10)], [1] * 10]
    return _flat(I.signature_scores(scores(s, d), sig))


@query("i15_one_hot_signature", "SELECT vec_id, array_to_string(list_transform(range(0, 4), lambda i: CASE WHEN i = label THEN 1 ELSE -1 END), ',') AS sig FROM (SELECT vec_id, CASE WHEN label % 3 = 2 THEN 3 ELSE label % 3 END AS label FROM embeddings)")
def i15(s, d):
    v = F.when(F.col("label") % 3 == 2, -1).otherwise(F.col("label") % 3)
    return table(s, d, "embeddings").select("vec_id", F.array_join(I.one_hot_signature(v, 4).cast("array<string>"), ",").alias("sig"))


DIST = "dist AS (SELECT vec_id // 50 AS seq_id, CAST(vec_id % 50 AS INTEGER) AS t, CAST(unnest(range(0, 4)) AS INTEGER) AS p1, 9 AS p2, unnest(list_transform(embedding[1:4], lambda x: CASE WHEN x > -1 THEN abs(CAST(x AS DOUBLE)) END)) AS distance FROM embeddings), edges AS (SELECT s AS state, p AS p1, 9 AS p2, (s >> p) % 2 = 1 AS present FROM (SELECT unnest(range(0, 16)) AS s), (SELECT unnest(range(0, 4)) AS p))"


@query("i17_distance_state_scores", "WITH " + DIST + " SELECT seq_id, t, state, round(sum(CASE WHEN present THEN -2 * distance ELSE 0.5 END), 5) AS s FROM dist JOIN edges USING (p1, p2) WHERE distance IS NOT NULL GROUP BY 1, 2, 3")
def i17(s, d):
    e = table(s, d, "embeddings").select(F.expr("vec_id div 50").alias("seq_id"), (F.col("vec_id") % 50).cast("int").alias("t"), F.posexplode(F.slice("embedding", 1, 4)).alias("p1", "x"))
    dist = e.select("seq_id", "t", "p1", F.lit(9).alias("p2"), F.when(F.col("x") > -1, F.abs(F.col("x").cast("double"))).alias("distance"))
    edges = s.range(16).select(F.col("id").alias("state"), F.posexplode(F.array(*[F.lit(1 << p) for p in range(4)])).alias("p1", "bit")).select("state", "p1", F.lit(9).alias("p2"), (F.expr("state & bit") > 0).alias("present"))
    return I.distance_state_scores(dist, edges, 2.0, 0.5).withColumn("s", F.round("s", 5))


@query("i18_joint_scores", SC + ", l AS (SELECT seq_id, t, CAST(unnest(range(0, 10)) AS INTEGER) AS c, unnest(score) AS s FROM scores) SELECT a.seq_id, a.t, a.c AS event, b.c AS state, round(0.3 * a.s + 0.7 * b.s, 5) AS s FROM l a JOIN l b ON a.seq_id = b.seq_id AND a.t = b.t AND b.c = (a.c * 3) % 10")
def i18(s, d):
    x = scores(s, d)
    allowed = s.range(10).select(F.col("id").cast("int").alias("event"), ((F.col("id") * 3) % 10).cast("int").alias("state"))
    return I.joint_scores(x, x, allowed, 0.3, 0.7).withColumn("s", F.round("s", 5))


@query("i19_transition_scores", SC + "SELECT seq_id, t, CAST(unnest(range(0, 4)) AS INTEGER) AS class_id, unnest([score[3], score[3], score[1], score[8]]) AS s FROM scores")
def i19(s, d):
    return I.long_form(scores(s, d).withColumn("score", X.pick(F.col("score"), [2, 2, 0, 7])))


@query("i20_lookup_event", with_(ANN) + ", f AS (SELECT action, part1, arg_min(event, ann_id) AS event FROM ann WHERE ann_id % 3 = 0 GROUP BY 1, 2) SELECT a.ann_id, a.action, a.part1 AS part, f.event FROM ann a LEFT JOIN f USING (action, part1)")
def i20(s, d):
    ann = annotations(s, d).select("ann_id", "action", F.col("part1").alias("part"), "event")
    return I.lookup_event(ann.drop("event"), ann.filter("ann_id % 3 = 0").withColumnRenamed("ann_id", "row")).select("ann_id", "action", "part", "event")


POINTS = "pts AS (SELECT vec_id // 50 AS seq_id, CAST(vec_id % 50 AS INTEGER) AS t, label AS cls, CASE WHEN vec_id % 11 > 0 THEN CAST(embedding[1] AS DOUBLE) END AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"


def _points(s, d):
    e = table(s, d, "embeddings")
    v = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return e.select(F.expr("vec_id div 50").alias("seq_id"), (F.col("vec_id") % 50).cast("int").alias("t"), F.col("label").alias("cls"), F.when(F.col("vec_id") % 11 > 0, v(0)).alias("x"), v(1).alias("y"))


GAUSS = "g AS (SELECT cls, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy FROM pts WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1)"


@query("i21_gaussian_scores", "WITH " + POINTS + ", " + GAUSS + " SELECT seq_id, t, g.cls, round(-0.5 * ((x - mx) ** 2 / vx + (y - my) ** 2 / vy + ln(vx * vy)) - ln(2 * pi()), 5) AS s FROM pts, g WHERE x IS NOT NULL")
def i21(s, d):
    p = _points(s, d)
    return I.gaussian_scores(p.drop("cls"), H.fit_gaussians(p)).filter(F.col("s") > float("-inf")).withColumn("s", F.round("s", 5))


@query("i22_bin_match_scores", with_(ANN) + ", a AS (SELECT DISTINCT action FROM ann), b AS (SELECT part2 AS bin, list(DISTINCT action) AS c FROM ann WHERE ann_id % 4 = 0 GROUP BY 1) SELECT action, bin, round(CASE WHEN list_contains(c, action) THEN ln(0.8) ELSE ln(0.2) END, 6) AS s FROM a, b")
def i22(s, d):
    ann = annotations(s, d)
    bins = ann.filter("ann_id % 4 = 0").groupBy(F.col("part2").alias("bin")).agg(F.collect_set("action").alias("contents"))
    return I.bin_match_scores(ann.select("action").distinct(), bins, 0.8).withColumn("s", F.round("s", 6))


@query("i23_split_signals", with_(FRAMES) + ", x AS (SELECT seq_id, code AS signal_id, t, CASE WHEN k > 95 THEN 1 ELSE 0 END AS label FROM frames) SELECT * FROM x SEMI JOIN (SELECT DISTINCT seq_id, signal_id FROM x WHERE label <> 0) USING (seq_id, signal_id)")
def i23(s, d):
    x = frames(s, d).select("seq_id", F.col("code").alias("signal_id"), "t", F.when(F.col("k") > 95, 1).otherwise(0).alias("label"))
    return I.split_signals(x).select("seq_id", "signal_id", "t", "label")


@query("i24_expand_scores", SC + "SELECT seq_id, t, CAST(unnest(range(0, 3)) AS INTEGER) AS class_id, unnest([score[1], score[1], score[5]]) AS s FROM scores")
def i24(s, d):
    return I.long_form(scores(s, d).withColumn("score", X.pick(F.col("score"), [0, 0, 4])))


@query(
    "i25_vote_group",
    SC + ", l AS (SELECT seq_id, t, CAST(unnest(range(0, 10)) AS INTEGER) AS c, unnest(score) AS s FROM scores), m AS (SELECT seq_id, t, c % 3 AS model, ln(sum(exp(s))) AS s FROM l GROUP BY 1, 2, 3), z AS (SELECT seq_id, model, sum(s) AS s FROM m GROUP BY 1, 2) SELECT seq_id, arg_max(model, s) AS model FROM z GROUP BY 1",
)
def i25(s, d):
    parts = s.range(10).select(F.col("id").cast("int").alias("part"), (F.col("id") % 3).cast("int").alias("model"))
    return I.vote_group(scores(s, d), parts)


@query(
    "i26_nearest_centers",
    "WITH " + POINTS + ", c AS (SELECT unnest([0, 1, 2]) AS bin, unnest([0.1, -0.1, 0.0]) AS cx, unnest([0.0, 0.1, -0.1]) AS cy), base AS (SELECT seq_id, t, x AS px, y AS py, arg_min(bin, struct_pack(d := (x - cx) ** 2 + (y - cy) ** 2, b := bin)) AS x FROM pts, c WHERE x IS NOT NULL GROUP BY 1, 2, 3, 4), "
    + "b2 AS (SELECT seq_id, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY t) - 1 AS INTEGER) AS t, px, py, x FROM base), fl AS (SELECT *, CASE WHEN lag(x) OVER (PARTITION BY seq_id ORDER BY t) IS NOT DISTINCT FROM x THEN 0 ELSE 1 END AS f FROM b2), nu AS (SELECT *, sum(f) OVER (PARTITION BY seq_id ORDER BY t) - 1 AS seg_id FROM fl) SELECT seq_id, CAST(seg_id AS BIGINT) AS seg_id, x AS bin, count(*) AS n, round(avg(px), 5) AS x, round(avg(py), 5) AS y FROM nu GROUP BY 1, 2, 3",
)
def i26(s, d):
    centers = s.createDataFrame([(0, 0.1, 0.0), (1, -0.1, 0.1), (2, 0.0, -0.1)], "bin int, cx double, cy double")
    return I.nearest_centers(_points(s, d).filter("x is not null"), centers).withColumn("x", F.round("x", 5)).withColumn("y", F.round("y", 5))


# folds; the draw is a column both engines compute alike
DRAW = "(seq_id * 7919) % 1009"
FOLDS = "ids AS (SELECT DISTINCT user_id AS seq_id FROM events), tiles AS (SELECT seq_id, CAST(ntile(5) OVER (ORDER BY (seq_id * 7919) % 1009, seq_id) - 1 AS INTEGER) AS tile FROM ids), f AS (SELECT CAST(fold AS INTEGER) AS fold, seq_id, tile = fold AS test FROM tiles, range(0, 5) u(fold)), o AS (SELECT *, row_number() OVER (PARTITION BY fold, test ORDER BY (seq_id * 104729) % 1013, seq_id) AS r, count(*) OVER (PARTITION BY fold, test) AS n FROM f), folds AS (SELECT fold, CASE WHEN test THEN 'test' WHEN r <= floor(n * 0.25) THEN 'val' ELSE 'train' END AS split, seq_id FROM o)"


def _folds(s, d):
    return J.make_folds(frames(s, d), 5, 0.25, F.expr(DRAW), F.expr("(seq_id * 104729) % 1013"))


@query("j1_make_folds", "WITH " + FOLDS + " SELECT fold, split, seq_id FROM folds")
def j1(s, d):
    return _folds(s, d)


@query("j2_group_folds", "WITH " + FOLDS.replace("SELECT DISTINCT user_id AS seq_id FROM events", "SELECT DISTINCT c_nationkey AS seq_id FROM customer") + " SELECT fold, split, c_custkey AS seq_id FROM customer JOIN folds ON folds.seq_id = c_nationkey")
def j2(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("seq_id"), F.col("c_nationkey").alias("grp"))
    return J.make_group_folds(c, "grp", 5, 0.25, F.expr("(grp * 7919) % 1009"), F.expr("(grp * 104729) % 1013"))


@query("j3_incomplete_folds", "WITH " + FOLDS + " SELECT fold, seq_id FROM folds WHERE split = 'test'")
def j3(s, d):
    return J.incomplete_folds(_folds(s, d).filter("split <> 'test'"), frames(s, d))


@query("j4_leave_one_out", with_(FRAMES) + ", h AS (SELECT DISTINCT seq_id, k * 100 + code AS label FROM frames) SELECT seq_id, label, count(*) OVER (PARTITION BY label) = 1 AS oov FROM h")
def j4(s, d):
    return K.leave_one_out(frames(s, d).withColumn("x", F.col("k") * 100 + F.col("code")), "x")


@query("j5_split_clips", with_(FRAMES, FOLDS) + "SELECT seq_id, t AS anchor, fold, split FROM frames JOIN folds USING (seq_id) WHERE t % 10 = 0")
def j5(s, d):
    from seqloom.operators.clips import window_clips

    return J.split_clips(window_clips(frames(s, d), 100, 10).select("seq_id", "anchor"), _folds(s, d))


RES = "res AS (SELECT user_id AS seq_id, event_type AS metric, value, CAST(json_extract(props, '$.k') AS INTEGER) % 3 AS sweep FROM events)"


def _results(s, d):
    return frames(s, d).select("seq_id", F.col("label").alias("metric"), F.col("score").alias("value"), (F.col("k") % 3).alias("sweep"))


@query("j6_summarize", "WITH " + RES + " SELECT sweep, metric, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std, count(value) AS n FROM res GROUP BY 1, 2")
def j6(s, d):
    return J.summarize_results(_results(s, d), "sweep").withColumn("mean", F.round("mean", 5)).withColumn("std", F.round("std", 5))


@query("j6_summarize_cube", "WITH " + RES + " SELECT sweep, metric, round(avg(value), 5) AS mean, count(value) AS n FROM res GROUP BY CUBE (sweep, metric)")
def j6b(s, d):
    return J.summarize_cube(_results(s, d), "sweep", "metric").withColumn("mean", F.round("mean", 5))


LAB = "lab AS (SELECT seq_id, t, code AS truth, coalesce(lag(code) OVER (PARTITION BY seq_id ORDER BY t), 0) AS pred, big FROM frames)"


def _labels(s, d):
    from pyspark.sql.window import Window

    before = F.lag("code").over(Window.partitionBy("seq_id").orderBy("t"))
    return frames(s, d).select("seq_id", "t", F.col("code").alias("truth"), F.coalesce(before, F.lit(0)).alias("pred"), "big", "k")


LABS = with_(FRAMES, LAB)


@query("j7_compare", LABS + ", a AS (SELECT pred, truth, count(*) AS n FROM lab WHERE seq_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT pred, truth, count(*) AS n FROM lab WHERE seq_id % 3 = 0 GROUP BY 1, 2) SELECT pred, truth, coalesce(b.n, 0) - coalesce(a.n, 0) AS diff FROM a FULL JOIN b USING (pred, truth)")
def j7(s, d):
    x = _labels(s, d)
    return K.compare_experiments(x.filter("seq_id % 2 = 0"), x.filter("seq_id % 3 = 0"))


@query("j8_interval", "WITH " + RES + " SELECT metric, round(quantile_cont(value, 0.16), 5) AS low, round(avg(value), 5) AS mean, round(quantile_cont(value, 0.84), 5) AS high FROM res GROUP BY 1")
def j8(s, d):
    return J.plain_interval(_results(s, d), 0.68).select("metric", *[F.round(c, 5).alias(c) for c in ("low", "mean", "high")])


DRAWS = """, w AS (SELECT seq_id, metric, sum(value) AS s, count(value) AS n FROM res WHERE value IS NOT NULL GROUP BY 1, 2),
 u AS (SELECT metric, r, s, n, CAST('0x' || substr(md5('0:' || seq_id || ':' || metric || ':' || (r // 4)), (r % 4) * 8 + 1, 8) AS BIGINT) AS u FROM w, range(0, 50) x(r)),
 m AS (SELECT metric, r, sum(k * s) / nullif(sum(k * n), 0) AS m FROM (SELECT *, len(list_filter([{edges}], lambda e: u >= e)) AS k FROM u) GROUP BY 1, 2) """


@query("j8_bootstrap", "WITH " + RES + DRAWS.replace("{edges}", ", ".join(map(str, J.poisson_edges()))) + "SELECT metric, round(quantile_cont(m, 0.16), 5) AS low, round(avg(m), 5) AS mean, round(quantile_cont(m, 0.84), 5) AS high FROM m GROUP BY 1")
def j8b(s, d):
    return J.bootstrap_interval(_results(s, d), 50, 0.68).select("metric", *[F.round(c, 5).alias(c) for c in ("low", "mean", "high")])


@query("j9_histogram", with_(FRAMES) + "SELECT label, CASE WHEN score < 0 THEN 0 WHEN score >= 200 THEN 21 ELSE CAST(floor(score / 10) + 1 AS INTEGER) END AS bucket, count(*) AS n FROM frames GROUP BY 1, 2")
def j9(s, d):
    return J.histogram(frames(s, d), "score", 0, 200, 20, "label")


@query("j10_linear_fit", with_(FRAMES) + "SELECT label, round(regr_slope(score, k), 5) AS slope, round(regr_intercept(score, k), 4) AS intercept FROM frames GROUP BY 1")
def j10(s, d):
    return J.linear_fit(frames(s, d), "k", "score", "label").select("label", F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("j11_cross_corpus", "SELECT 0 AS fold, 'train' AS split, user_id AS seq_id FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT 0, 'test', o_custkey FROM (SELECT DISTINCT o_custkey FROM orders)")
def j11(s, d):
    return J.cross_corpus_fold(frames(s, d), annotations(s, d))


@query("k1_accuracy", LABS + "SELECT seq_id, round(avg(CAST(pred = truth AS INTEGER)), 6) AS accuracy FROM lab GROUP BY 1")
def k1(s, d):
    return K.accuracy(_labels(s, d), "seq_id").withColumn("accuracy", F.round("accuracy", 6))


@query("k2_prf", LABS + ", c AS (SELECT seq_id, count(*) FILTER (pred = truth AND truth <> 0) AS tp, count(*) FILTER (pred <> 0 AND pred <> truth) AS fp, count(*) FILTER (truth <> 0 AND pred <> truth) AS fn FROM lab GROUP BY 1) SELECT seq_id, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c")
def k2(s, d):
    x = K.prf(_labels(s, d), "seq_id")
    return x.select("seq_id", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("k3_attribute_prf", LABS + ", v AS (SELECT CAST(a AS INTEGER) AS attr, (truth + a) % 2 AS t, (pred + a) % 2 AS p FROM lab, range(0, 2) u(a)) SELECT attr, count(*) FILTER (t = 1 AND p = 1) AS tp, count(*) FILTER (t = 0 AND p = 1) AS fp, count(*) FILTER (t = 1 AND p = 0) AS fn, count(*) FILTER (t = 0 AND p = 0) AS tn FROM v GROUP BY 1")
def k3(s, d):
    x = _labels(s, d)
    attrs = x.select(F.col("truth").alias("label")).distinct().select("label", F.explode(F.array(F.lit(0), F.lit(1))).alias("attr")).withColumn("value", (F.col("label") + F.col("attr")) % 2)
    return K.attribute_prf(x, attrs)


SEGTEXT = """ft AS (SELECT *, CASE WHEN lag(truth) OVER w IS NOT DISTINCT FROM truth AND t > 0 THEN 0 ELSE 1 END AS a, CASE WHEN lag(pred) OVER w IS NOT DISTINCT FROM pred AND t > 0 THEN 0 ELSE 1 END AS b FROM lab WINDOW w AS (PARTITION BY seq_id ORDER BY t)),
 ns AS (SELECT *, sum(a) OVER (PARTITION BY seq_id ORDER BY t) AS sa, sum(b) OVER (PARTITION BY seq_id ORDER BY t) AS sb FROM ft)"""


@query("k4_edit_score", with_(FRAMES, LAB, SEGTEXT) + "SELECT seq_id, round(1 - levenshtein(x, y) / greatest(length(x), length(y)), 6) AS edit FROM (SELECT seq_id, string_agg(chr(truth + 48), '' ORDER BY t) FILTER (a = 1) AS x, string_agg(chr(pred + 48), '' ORDER BY t) FILTER (b = 1) AS y FROM ns GROUP BY 1)")
def k4(s, d):
    return K.edit_score(_labels(s, d)).withColumn("edit", F.round("edit", 6))


@query(
    "k5_overlap_score",
    with_(FRAMES, LAB, SEGTEXT) + ", x AS (SELECT seq_id, sa, truth AS l, min(t) AS a, max(t) AS b FROM ns GROUP BY 1, 2, 3), y AS (SELECT seq_id, sb, pred AS l, min(t) AS c, max(t) AS e FROM ns GROUP BY 1, 2, 3), z AS (SELECT x.seq_id, sa, coalesce(max(CAST(least(b, e) - greatest(a, c) + 1 AS BIGINT) * 1000000000 // (greatest(b, e) - least(a, c) + 1)) FILTER (c IS NOT NULL), 0) AS iou FROM x LEFT JOIN y ON x.seq_id = y.seq_id AND x.l = y.l AND c <= b AND a <= e GROUP BY 1, 2) SELECT seq_id, ((2 * sum(iou) + 1000 * count(*)) // (2000 * count(*))) / 1000000 AS overlap FROM z GROUP BY 1",
)
def k5(s, d):
    return K.overlap_score(_labels(s, d))


@query("k6_confusion", LABS + "SELECT pred, truth, count(*) AS n FROM lab GROUP BY 1, 2")
def k6(s, d):
    return K.confusion(_labels(s, d))


@query("k6_class_accuracy", LABS + "SELECT truth, round(avg(CAST(pred = truth AS INTEGER)), 6) AS accuracy, count(*) AS n FROM lab GROUP BY 1")
def k6b(s, d):
    return K.class_accuracy(_labels(s, d)).withColumn("accuracy", F.round("accuracy", 6))


@query("k7_accuracy_upto", LABS + "SELECT seq_id, round(avg(CAST(pred % 2 = truth % 2 AS INTEGER)), 6) AS accuracy FROM lab GROUP BY 1")
def k7(s, d):
    return K.accuracy(_labels(s, d), "seq_id", equal=F.col("pred") % 2 == F.col("truth") % 2).withColumn("accuracy", F.round("accuracy", 6))


@query("k10_oov_rate", with_(FRAMES) + "SELECT round(avg(CAST(y IS NULL AS INTEGER)), 6) AS rate FROM (SELECT k * 100 + code AS x FROM frames WHERE seq_id % 2 = 0) a LEFT JOIN (SELECT DISTINCT k * 100 + code AS y FROM frames WHERE seq_id % 2 = 1) b ON x = y")
def k10(s, d):
    f = frames(s, d).withColumn("x", F.col("k") * 100 + F.col("code"))
    return K.oov_rate(f.filter("seq_id % 2 = 0"), f.filter("seq_id % 2 = 1"), "x").withColumn("rate", F.round("rate", 6))


@query("k11_contextual_oov", with_(FRAMES) + ", x AS (SELECT seq_id, t, k * 100 + code AS l FROM frames), o AS (SELECT l, count(DISTINCT seq_id) = 1 AS oov FROM x GROUP BY 1), y AS (SELECT seq_id, oov, lag(oov) OVER (PARTITION BY seq_id ORDER BY t) AS before_oov FROM x JOIN o USING (l)) SELECT before_oov, round(avg(CAST(oov AS INTEGER)), 6) AS rate, count(*) AS n FROM y GROUP BY 1")
def k11(s, d):
    return K.contextual_oov(frames(s, d).withColumn("x", F.col("k") * 100 + F.col("code")), "x").withColumn("rate", F.round("rate", 6))


@query("k12_oov_predictions", with_(FRAMES) + ", x AS (SELECT seq_id, t, k * 10 + code AS truth, lag(k * 10 + code, 1, 0) OVER (PARTITION BY seq_id ORDER BY t) AS pred FROM frames), h AS (SELECT DISTINCT seq_id, truth FROM x), z AS (SELECT *, NOT EXISTS (SELECT 1 FROM h WHERE h.truth = x.pred AND h.seq_id <> x.seq_id) AS oov FROM x) SELECT count(*) AS n, count(*) FILTER (oov) AS n_oov, count(*) FILTER (oov AND pred = truth) AS n_right FROM z")
def k12(s, d):
    from pyspark.sql.window import Window

    x = frames(s, d).withColumn("truth", F.col("k") * 10 + F.col("code"))
    x = x.withColumn("pred", F.lag("truth", 1, 0).over(Window.partitionBy("seq_id").orderBy("t")))
    return K.oov_predictions(x.select("seq_id", "t", "truth", "pred"))


@query("k13_correctable", "WITH x AS (SELECT label, list_transform(embedding[1:10], lambda v: CAST(v AS DOUBLE)) AS a, list_transform(embedding[11:20], lambda v: CAST(v AS DOUBLE)) AS b FROM embeddings), y AS (SELECT *, list_position(a, list_max(a)) AS pa, list_position(b, list_max(b)) AS pb FROM x) SELECT count(*) FILTER (pa - 1 <> label) AS errors, count(*) FILTER (pa - 1 <> label AND pb - 1 = label AND b[label + 1] > b[pa]) AS correctable, count(*) FILTER (pa <> pb) AS changed FROM y")
def k13(s, d):
    e = table(s, d, "embeddings")
    part = lambda i: F.transform(F.slice("embedding", i, 10), lambda v: v.cast("double"))
    return K.correctable_errors(e.select(F.col("label").alias("truth"), part(1).alias("a"), part(11).alias("b")))


@query("k15_segment_retrieval", runs_of("big") + ', kf AS (SELECT r.seq_id, r.seg_id, count(f.t) AS n FROM runs r LEFT JOIN (SELECT * FROM frames WHERE k > 60) f ON f.seq_id = r.seq_id AND f.t BETWEEN r.start AND r."end" GROUP BY 1, 2) SELECT count(*) FILTER (n = 1) AS tp, count(*) FILTER (n = 0) AS fp, count(*) FILTER (n > 1) AS fn FROM kf')
def k15(s, d):
    f = frames(s, d)
    return K.segment_retrieval(to_segments(f, "big"), f.filter("k > 60"))


@query(
    "k16_adjusted_rand",
    with_(FRAMES) + ", c AS (SELECT seq_id, code AS a, big AS b, count(*) AS n FROM frames GROUP BY 1, 2, 3), x AS (SELECT seq_id, sum(n * (n - 1) / 2) AS ij, sum(n) AS al FROM c GROUP BY 1), y AS (SELECT seq_id, sum(m * (m - 1) / 2) AS i FROM (SELECT seq_id, a, sum(n) AS m FROM c GROUP BY 1, 2) GROUP BY 1), z AS (SELECT seq_id, sum(m * (m - 1) / 2) AS j FROM (SELECT seq_id, b, sum(n) AS m FROM c GROUP BY 1, 2) GROUP BY 1) SELECT seq_id, round(coalesce((ij - i * j / (al * (al - 1) / 2)) / nullif((i + j) / 2 - i * j / (al * (al - 1) / 2), 0), 1), 6) AS ari FROM x JOIN y USING (seq_id) JOIN z USING (seq_id)",
)
def k16(s, d):
    return K.adjusted_rand(_labels(s, d).withColumn("pred", F.col("big"))).withColumn("ari", F.round("ari", 6))


@query("k17_final_states", with_(FRAMES) + "SELECT seq_id, arg_max(label, t) AS label FROM frames GROUP BY 1")
def k17(s, d):
    return K.final_states(frames(s, d), "label")


@query("k19_confident_accuracy", SC + "SELECT seq_id, round(avg(CAST(list_position(score, list_max(score)) - 1 = label AS INTEGER)), 6) AS accuracy FROM scores WHERE list_max(score) > 0.25 GROUP BY 1")
def k19(s, d):
    x = scores(s, d).filter(F.array_max("score") > 0.25).withColumn("pred", X.argmax(F.col("score"))).withColumnRenamed("label", "truth")
    return K.accuracy(x, "seq_id").withColumn("accuracy", F.round("accuracy", 6))


@query("k20_mean_deviation", "WITH " + RES + " SELECT metric, round(100 * avg(value), 4) AS mean, round(100 * stddev_pop(value), 4) AS std FROM res GROUP BY 1")
def k20(s, d):
    return K.mean_and_deviation(_results(s, d), "metric").select("metric", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("k21_ratio_scores", with_(FRAMES) + "SELECT label AS metric, sum(big) AS num, sum(k) AS den, round(sum(big) / sum(k), 6) AS value FROM frames GROUP BY 1")
def k21(s, d):
    x = frames(s, d).select(F.col("label").alias("metric"), F.col("big").alias("num"), F.col("k").alias("den"))
    return K.ratio_scores(x).withColumn("value", F.round("value", 6))


BI = with_(FRAMES) + ", p AS (SELECT lag(label) OVER (PARTITION BY seq_id ORDER BY t) AS src, label AS dst FROM frames), n AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS n FROM p WHERE src IS NOT NULL GROUP BY 1, 2)"


@query("h1_transition_counts", BI + " SELECT src, dst, n, round(n / sum(n) OVER (PARTITION BY src), 6) AS prob FROM n")
def h1(s, d):
    return H.transition_counts(frames(s, d), "label").withColumn("prob", F.round("prob", 6))


@query("h2_regularised", BI + ", v AS (SELECT DISTINCT label FROM frames), g AS (SELECT a.label AS src, b.label AS dst FROM v a, v b), m AS (SELECT src, dst, coalesce(n, 0) + 1 + CASE WHEN src = dst THEN 5 ELSE 0 END AS n FROM g LEFT JOIN n USING (src, dst)) SELECT src, dst, n, round(n / sum(n) OVER (PARTITION BY src), 6) AS prob FROM m")
def h2(s, d):
    return H.transition_counts(frames(s, d), "label", 1.0, 5.0).withColumn("prob", F.round("prob", 6))


ENDS = "e AS (SELECT seq_id, arg_min(label, t) AS a, arg_max(label, t) AS b FROM frames GROUP BY 1)"


@query("h3_smooth_counts", BI + ", " + ENDS + ", l AS (SELECT DISTINCT x AS src, x AS dst, 2.0 AS n FROM (SELECT a AS x FROM e UNION SELECT b FROM e)), m AS (SELECT src, dst, sum(n) AS n FROM (SELECT * FROM n UNION ALL SELECT * FROM l) GROUP BY 1, 2) SELECT 'move' AS kind, src, dst, round(n / sum(n) OVER (PARTITION BY src), 6) AS prob FROM m UNION ALL SELECT 'start', NULL, a, round(count(*) / sum(count(*)) OVER (), 6) FROM e GROUP BY a UNION ALL SELECT DISTINCT 'end', b, NULL, 1.0 FROM e")
def h3(s, d):
    return H.smooth_counts(frames(s, d), "label", 2.0).withColumn("prob", F.round("prob", 6))


@query("h4_endpoint_priors", with_(FRAMES, ENDS) + "SELECT label, round(sum(s) / sum(sum(s)) OVER (), 6) AS start, round(sum(z) / sum(sum(z)) OVER (), 6) AS \"end\" FROM (SELECT a AS label, 1 AS s, 0 AS z FROM e UNION ALL SELECT b, 0, 1 FROM e) GROUP BY 1")
def h4(s, d):
    return H.endpoint_priors(frames(s, d), "label").select("label", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query("h5_duration_priors", runs_of("label") + ", q AS (SELECT label, n AS dur, count(*) AS n FROM runs GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY label ORDER BY dur) / sum(n) OVER (PARTITION BY label) AS cdf FROM q), k AS (SELECT * FROM c WHERE dur <= (SELECT max(m) FROM (SELECT label, min(dur) AS m FROM c WHERE cdf >= 0.95 GROUP BY 1))) SELECT label, dur, n, round(n / sum(n) OVER (PARTITION BY label), 6) AS prob FROM k")
def h5(s, d):
    return H.duration_priors(frames(s, d), "label").withColumn("prob", F.round("prob", 6))


@query("h6_cooccurrence", with_(FRAMES) + "SELECT code AS action, coalesce(part, 0) AS part, count(*) AS n FROM (SELECT code, CASE WHEN k % 4 = 0 THEN NULL ELSE k % 4 END AS part FROM frames) GROUP BY 1, 2")
def h6(s, d):
    f = frames(s, d).withColumn("p", F.when(F.col("k") % 4 == 0, F.array().cast("array<int>")).otherwise(F.array(F.col("k") % 4)))
    return H.cooccurrence(f, "code", "p")


@query("h7_edge_frequencies", with_(FRAMES) + ", a AS (SELECT seq_id, t // 5 AS t, code AS edge FROM frames WHERE score > 40 GROUP BY 1, 2, 3), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT seq_id, t // 5 FROM frames)) SELECT x.edge AS e1, y.edge AS e2, round(count(*) / any_value(n.n), 6) AS share FROM a x JOIN a y ON x.seq_id = y.seq_id AND x.t = y.t AND x.edge <= y.edge, n GROUP BY 1, 2")
def h7(s, d):
    f = frames(s, d).withColumn("t", F.expr("t div 5"))
    active = f.filter("score > 40").select("seq_id", "t", F.col("code").alias("edge")).distinct()
    return H.edge_frequencies(active, f.select("seq_id", "t").distinct().count()).withColumn("share", F.round("share", 6))


STATES = "st AS (SELECT key AS state_id, parts FROM (SELECT array_to_string(parts, ',') AS key, parts FROM (SELECT DISTINCT list_sort(list_distinct(list(part))) AS parts FROM acts GROUP BY seq_id) UNION SELECT '', []))"


def _states(s, d):
    sets = part_actions(s, d).groupBy("seq_id").agg(F.array_sort(F.collect_set("part")).alias("parts")).select("parts").distinct()
    sets = sets.unionByName(sets.select(F.array().cast("array<int>").alias("parts"))).distinct()
    return sets.select(F.concat_ws(",", F.col("parts").cast("array<string>")).alias("state_id"), "parts")


@query("h8_allowed_transitions", with_(PARTS, STATES) + "SELECT a.state_id AS src, b.state_id AS dst FROM st a JOIN st b ON len(b.parts) = len(a.parts) + 1 AND list_has_all(b.parts, a.parts)")
def h8(s, d):
    return H.allowed_transitions(_states(s, d))


VEC = "v AS (SELECT DISTINCT [CAST(l_linenumber AS INTEGER) % 4, CAST(l_quantity AS INTEGER) % 4, CAST(l_suppkey AS INTEGER) % 4] AS v FROM lineitem), w AS (SELECT array_to_string(v, '') AS id, v FROM v)"


def _hamming(li):
    v = li.select(F.array((F.col("l_linenumber") % 4).cast("int"), (F.col("l_quantity").cast("int") % 4).cast("int"), (F.col("l_suppkey") % 4).cast("int")).alias("v")).distinct()
    return H.hamming_one(v.select(F.concat_ws("", F.col("v").cast("array<string>")).alias("id"), "v")).withColumn("prob", F.round("prob", 6))


HAMMING = "SELECT a.id AS a, b.id AS b, round(1.0 / count(*) OVER (PARTITION BY a.id), 6) AS prob FROM w a JOIN w b ON CAST(a.v[1] <> b.v[1] AS INTEGER) + CAST(a.v[2] <> b.v[2] AS INTEGER) + CAST(a.v[3] <> b.v[3] AS INTEGER) = 1"


@query("h10_hamming_one", "WITH " + VEC + " " + HAMMING)
def h10(s, d):
    return _hamming(table(s, d, "lineitem"))



@query("h10_hamming_one_all", "WITH " + VEC + " " + HAMMING)
def h10_all(s, d):
    return _hamming(table(s, d, "lineitem"))


@query("h11_event_transitions", with_(PARTS, STATES) + "SELECT list_filter(b.parts, lambda x: NOT list_contains(a.parts, x))[1] AS event, a.state_id AS src, b.state_id AS dst FROM st a JOIN st b ON len(b.parts) = len(a.parts) + 1 AND list_has_all(b.parts, a.parts)")
def h11(s, d):
    return H.event_transitions(_states(s, d))


@query("h12_endpoint_support", with_(PARTS, STATES) + "SELECT state_id, len(parts) = 0 AS can_start, len(parts) >= 4 AS can_end FROM st")
def h12(s, d):
    return H.endpoint_support(_states(s, d), F.size("parts") >= 4)


@query("h13_transition_table", "WITH w AS (SELECT c_nationkey AS action, sum(c_acctbal) FILTER (c_custkey % 2 = 0) AS a, sum(abs(c_acctbal)) AS b FROM customer GROUP BY 1), l AS (SELECT action, 0 AS src, 1 AS dst, a AS value FROM w UNION ALL SELECT action, 1, 0, b FROM w) SELECT action, src, dst, round(value / sum(value) OVER (PARTITION BY action), 5) AS value FROM l")
def h13(s, d):
    c = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("action")).agg(F.sum(F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal"))).alias("0->1"), F.sum(F.abs("c_acctbal")).alias("1->0"))
    return H.parse_transition_table(c, "action", True).withColumn("value", F.round("value", 5))


@query("h15_state_connections", with_(PARTS, STATES) + "SELECT state_id, joint, CAST(list_contains(parts, joint) AS INTEGER) AS connected FROM st, (SELECT DISTINCT unnest(parts) AS joint FROM st)")
def h15(s, d):
    return H.state_connections(_states(s, d))


@query("h17_pack_scores", BI + ", " + ENDS + " SELECT -1 AS src, ascii(a) AS dst, CAST(count(*) AS DOUBLE) AS s FROM e GROUP BY a UNION ALL SELECT ascii(src), ascii(dst), n FROM n UNION ALL SELECT ascii(b), -1, CAST(count(*) AS DOUBLE) FROM e GROUP BY b")
def h17(s, d):
    f = frames(s, d)
    ends = f.groupBy("seq_id").agg(F.min_by("label", "t").alias("a"), F.max_by("label", "t").alias("b"))
    count = lambda c: ends.groupBy(F.ascii(c).alias("label")).agg(F.count("*").cast("double").alias("s"))
    moves = H.transition_counts(f, "label").select(F.ascii("src").alias("src"), F.ascii("dst").alias("dst"), F.col("n").alias("s"))
    return H.pack_scores(count("a"), moves, count("b"))


@query("h18_transitions_from_map", "SELECT DISTINCT c_nationkey AS src, c_nationkey + CAST(unnest([1, 2]) AS INTEGER) AS dst FROM customer")
def h18(s, d):
    n = table(s, d, "customer").select("c_nationkey").distinct()
    return H.transitions_from_map(n.select(F.create_map("c_nationkey", F.array(F.col("c_nationkey") + 1, F.col("c_nationkey") + 2)).alias("m")), "m")


@query("h20_fit_gaussians", "WITH " + POINTS + " SELECT cls, count(*) AS n, round(avg(x), 6) AS mx, round(avg(y), 6) AS my, round(var_pop(x), 6) AS vx, round(var_pop(y), 6) AS vy, round(covar_pop(x, y), 6) AS cxy FROM pts WHERE x IS NOT NULL GROUP BY 1")
def h20(s, d):
    return H.fit_gaussians(_points(s, d)).select("cls", "n", *[F.round(c, 6).alias(c) for c in ("mx", "my", "vx", "vy", "cxy")])


@query("h21_trim_and_refit", "WITH " + POINTS + ", r AS (SELECT *, percent_rank() OVER (PARTITION BY cls ORDER BY y) AS r FROM pts) SELECT cls, count(*) AS n, round(avg(x), 6) AS mx, round(avg(y), 6) AS my FROM r WHERE r >= 0.05 AND x IS NOT NULL GROUP BY 1")
def h21(s, d):
    return H.trim_and_refit(_points(s, d).withColumn("score", F.col("y"))).select("cls", "n", F.round("mx", 6).alias("mx"), F.round("my", 6).alias("my"))


@query("h22_duration_gaussians", with_(ANN) + 'SELECT action AS label, round(avg("end" - start), 6) AS mean, round(stddev_samp("end" - start), 6) AS std, max("end" - start) AS longest FROM ann GROUP BY 1')
def h22(s, d):
    return H.duration_gaussians(annotations(s, d).withColumnRenamed("action", "label")).select("label", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "longest")


@query("h23_fit_bins")
def h23(s, d):
    return H.fit_bins(H.fit_gaussians(_points(s, d)), 4)


@query("h24_inlier_mean", "SELECT round(avg(l_extendedprice), 4) AS scale FROM lineitem WHERE l_extendedprice <= 20000")
def h24(s, d):
    return H.inlier_mean(table(s, d, "lineitem").select(F.col("l_extendedprice").alias("error"))).withColumn("scale", F.round("scale", 4))


@query("h25_pair_rates", "SELECT l_partkey % 2 = 0 AND l_suppkey % 3 = 0 AS connected, round(1 / avg(l_quantity), 6) AS rate FROM lineitem GROUP BY 1")
def h25(s, d):
    li = table(s, d, "lineitem").select(F.col("l_partkey").alias("p1"), F.col("l_suppkey").alias("p2"), F.col("l_quantity").alias("value"))
    adj = li.filter("p1 % 2 = 0 and p2 % 3 = 0").select("p1", "p2").distinct()
    return H.fit_pair_rates(li, adj).withColumn("rate", F.round("rate", 6))
