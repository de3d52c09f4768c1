"""Registered queries: bookkeeping (A), clocks (B), clips (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import align as A
from seqloom.operators import clips as E
from seqloom.operators.segments import min_states
from seqloom.plans.inputs import ANN, FRAMES, MONTHS, PAIRS, SCORES, SIGNAL, annotations, frames, months, scores, signal, table, with_
from seqloom.plans.intervals import runs_of
from seqloom.plans.registry import query

DAY = 86_400_000_000


@query("a2_open_ends", """SELECT seq_id, ann_id, start, CASE WHEN e = 0 THEN lead(start) OVER (PARTITION BY seq_id ORDER BY start, ann_id) ELSE e END AS "end" FROM (SELECT *, CASE WHEN action < 5 THEN 0 ELSE "end" END AS e FROM ann)""".join([with_(ANN), ""]))
def a2(s, d):
    ann = annotations(s, d).withColumn("end", F.when(F.col("action") < 5, 0).otherwise(F.col("end")))
    return A.fill_open_ends(ann).select("seq_id", "ann_id", "start", "end")


@query("a6_load_metadata", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_nationkey = 3 AND c_custkey IS NOT NULL")
def a6(s, d):
    return A.load_metadata(table(s, d, "customer"), "c_custkey", {"c_mktsegment": "MACHINERY", "c_nationkey": 3}, ["c_acctbal"])


@query("a9_export_clip_labels", with_(FRAMES) + "SELECT 'seq-' || seq_id AS video_name, CAST(greatest(t - 50, 0) AS INTEGER) AS start_index, CAST(least(t + 49, m) AS INTEGER) AS end_index, label AS label_id FROM (SELECT *, max(t) OVER (PARTITION BY seq_id) AS m FROM frames) WHERE t % 10 = 0")
def a9(s, d):
    from seqloom.sources.exports import clip_labels

    return clip_labels(E.window_clips(frames(s, d), 100, 10))


@query("a10_export_segments", runs_of("label") + 'SELECT seq_id, start, "end", label FROM runs')
def a10(s, d):
    from seqloom.sources.exports import segment_labels

    return segment_labels(frames(s, d))


@query("a12_common_sequences", "SELECT DISTINCT user_id AS seq_id FROM events SEMI JOIN (SELECT o_custkey AS user_id FROM orders WHERE o_orderstatus = 'F') USING (user_id)")
def a12(s, d):
    return A.common_sequences(frames(s, d), annotations(s, d).filter("event like 'F%'"))


@query(
    "a13_sequence_audit",
    "WITH a AS (SELECT DISTINCT user_id AS seq_id FROM events), b AS (SELECT DISTINCT c_custkey AS seq_id FROM customer WHERE c_nationkey < 20), c AS (SELECT DISTINCT o_custkey AS seq_id FROM orders) SELECT seq_id, nullif(concat_ws('', CASE WHEN x = '' THEN '' ELSE 'no ' END, x), '') AS reason FROM (SELECT coalesce(a.seq_id, b.seq_id, c.seq_id) AS seq_id, array_to_string(list_filter([CASE WHEN c.seq_id IS NULL THEN 'annotations' END, CASE WHEN a.seq_id IS NULL THEN 'frames' END, CASE WHEN b.seq_id IS NULL THEN 'metadata' END], lambda y: y IS NOT NULL), ', ') AS x FROM a FULL JOIN b ON a.seq_id = b.seq_id FULL JOIN c ON c.seq_id = coalesce(a.seq_id, b.seq_id))",
)
def a13(s, d):
    meta = table(s, d, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("seq_id"))
    return A.sequence_audit(annotations=annotations(s, d), frames=frames(s, d), metadata=meta)


@query("a14_equal_length", with_(FRAMES, SIGNAL) + "SELECT seq_id, n FROM (SELECT seq_id, count(*) AS n FROM sig WHERE device = 0 GROUP BY 1) JOIN (SELECT seq_id, count(*) AS n FROM sig WHERE device = 1 GROUP BY 1) USING (seq_id, n)")
def a14(s, d):
    x = signal(s, d)
    return A.equal_length_only(x.filter("device = 0"), x.filter("device = 1"))


@query("a15_drop_invalid", with_(FRAMES) + "SELECT seq_id, t, v FROM (SELECT *, CASE WHEN score < 300 THEN score END AS v FROM frames) ANTI JOIN (SELECT DISTINCT seq_id FROM frames WHERE score >= 300) USING (seq_id)")
def a15(s, d):
    f = frames(s, d).select("seq_id", "t", F.when(F.col("score") < 300, F.col("score")).otherwise(F.lit(float("nan"))).alias("v"))
    return A.drop_invalid_sequences(A.null_if_nan(f), "v")


@query("a16_limit_subsample", with_(FRAMES) + "SELECT seq_id, CAST(t // 3 AS INTEGER) AS t, label FROM frames WHERE t % 3 = 0 AND seq_id IN (SELECT DISTINCT seq_id FROM frames ORDER BY 1 LIMIT 20)")
def a16(s, d):
    return A.subsample(A.limit_sequences(frames(s, d), 20), 3).select("seq_id", "t", "label")


@query("a17_unflatten", with_(FRAMES) + "SELECT seq_id, t, score FROM frames")
def a17(s, d):
    f = frames(s, d).withColumn("offset", F.col("t") % 16).withColumn("win_start", F.col("t") - F.col("offset"))
    index = f.select("seq_id", "win_start").distinct().withColumn("batch_id", F.concat_ws("-", "seq_id", "win_start"))
    return A.unflatten_batches(f.select(F.concat_ws("-", "seq_id", "win_start").alias("batch_id"), "offset", "score"), index)


@query("a18_attach_clip_scores", with_(SCORES) + "SELECT 'v' || seq_id AS video, t AS clip_id, CAST(list_position(score, list_max(score)) - 1 AS INTEGER) AS pred FROM scores WHERE seq_id = 1")
def a18(s, d):
    x = scores(s, d).filter("seq_id = 1")
    clips = x.select(F.concat(F.lit("v"), "seq_id").alias("video"), F.col("t").alias("clip_id"))
    return A.attach_clip_scores(clips, x.select(F.col("t").alias("clip_id"), "score")).drop("score")


@query("a19_sample_per_sequence", with_(FRAMES) + "SELECT seq_id, t FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY (us % 1000003), t) AS r FROM frames WHERE score > 10) WHERE r <= 5")
def a19(s, d):
    return A.sample_per_sequence(frames(s, d).filter("score > 10"), 5, F.col("us") % 1000003).select("seq_id", "t")


@query("a20_min_states", with_(FRAMES) + "SELECT seq_id, t FROM frames WHERE seq_id IN (SELECT seq_id FROM frames GROUP BY 1 HAVING count(*) >= 65)")
def a20(s, d):
    return min_states(frames(s, d), 65).select("seq_id", "t")


BOUNDS = with_(FRAMES) + ", bounds AS (SELECT seq_id, max(a) AS lo, min(b) AS hi FROM (SELECT seq_id, label, min(us) AS a, max(us) AS b FROM frames GROUP BY 1, 2) GROUP BY 1 HAVING max(a) <= min(b))"


def _bounds(s, d):
    return A.sequence_bounds(frames(s, d).withColumnRenamed("label", "sensor"))


@query("b1_sequence_bounds", BOUNDS + " SELECT * FROM bounds")
def b1(s, d):
    return _bounds(s, d)


GRID = BOUNDS + f", grid AS (SELECT seq_id, unnest(range(0, (hi - lo) // {DAY} + 1)) AS i, lo + unnest(range(0, (hi - lo) // {DAY} + 1)) * {DAY} AS us FROM bounds)"


@query("b2_sample_grid", GRID + " SELECT seq_id, i, us FROM grid")
def b2(s, d):
    return A.sample_grid(_bounds(s, d), DAY)


NEAR = """, near AS (SELECT g.seq_id, g.{i}, g.us, arg_min(struct_pack(u := f.us, v := f.score), struct_pack(d := abs(f.us - g.us), u := f.us)) AS x FROM {g} g JOIN (SELECT * FROM frames WHERE label = 'click') f ON f.seq_id = g.seq_id GROUP BY 1, 2, 3)"""


@query("b3_resample_nearest", GRID + NEAR.format(i="i", g="grid") + " SELECT seq_id, i, us, x.u AS sample_us, x.v AS score FROM near")
def b3(s, d):
    clicks = frames(s, d).filter("label = 'click'").select("seq_id", "us", "score")
    return A.resample_nearest(clicks, A.sample_grid(_bounds(s, d), DAY), ["seq_id"], ["score"])


@query(
    "b4_zero_for_missing",
    GRID + """, few AS (SELECT * FROM frames WHERE score > 120), dev AS (SELECT seq_id, i, us, unnest([0, 1, 2]) AS device FROM grid)
 SELECT g.seq_id, g.i, g.us, g.device, coalesce(arg_min(f.score, struct_pack(d := abs(f.us - g.us), u := f.us)), 0.0) AS score, arg_min(f.us, struct_pack(d := abs(f.us - g.us), u := f.us)) AS sample_us
 FROM dev g LEFT JOIN few f ON f.seq_id = g.seq_id AND f.code = g.device GROUP BY 1, 2, 3, 4""",
)
def b4(s, d):
    few = frames(s, d).filter("score > 120").select("seq_id", F.col("code").alias("device"), "us", "score")
    return A.zero_for_missing(A.sample_grid(_bounds(s, d), DAY), few, [0, 1, 2], "score")


@query(
    "b5_map_intervals",
    with_(FRAMES) + """, c1 AS (SELECT seq_id, t, us FROM frames WHERE label = 'click'), c2 AS (SELECT seq_id, t, us FROM frames WHERE label = 'view'),
 near AS (SELECT c1.seq_id, c1.t, arg_min(c2.t, struct_pack(d := abs(c2.us - c1.us), u := c2.us)) AS m FROM c1 JOIN c2 USING (seq_id) GROUP BY 1, 2),
 iv AS (SELECT seq_id, t AS start, lead(t) OVER (PARTITION BY seq_id ORDER BY t) AS "end" FROM c1)
 SELECT iv.seq_id, iv.start AS ann_id, a.m AS start, b.m AS "end" FROM iv JOIN near a ON a.seq_id = iv.seq_id AND a.t = iv.start JOIN near b ON b.seq_id = iv.seq_id AND b.t = iv."end" WHERE iv."end" IS NOT NULL""",
)
def b5(s, d):
    from pyspark.sql.window import Window

    f = frames(s, d)
    one, two = (f.filter(f"label = '{x}'").select("seq_id", "t", "us") for x in ("click", "view"))
    iv = one.select("seq_id", F.col("t").alias("ann_id"), F.col("t").alias("start"), F.lead("t").over(Window.partitionBy("seq_id").orderBy("t")).alias("end")).filter("end is not null")
    return A.map_intervals(iv, one, two).filter("start is not null and end is not null")


@query(
    "b6_pin_endpoints",
    with_(ANN) + """, m AS (SELECT *, row_number() OVER w AS r, lead(ann_id) OVER w AS nx FROM ann WINDOW w AS (PARTITION BY seq_id ORDER BY start, ann_id)), n AS (SELECT seq_id, max("end") + 5 AS n FROM ann GROUP BY 1)
 SELECT seq_id, ann_id, CASE WHEN r = 1 THEN 0 ELSE start END AS start, CASE WHEN nx IS NULL THEN n - 1 ELSE "end" END AS "end" FROM m JOIN n USING (seq_id)""",
)
def b6(s, d):
    ann = annotations(s, d)
    return A.pin_endpoints(ann.select("seq_id", "ann_id", "start", "end"), ann.groupBy("seq_id").agg((F.max("end") + 5).alias("n")))


@query("b7_frame_to_sample", with_(ANN) + """, fr AS (SELECT seq_id, event AS name, min(start) AS frame FROM ann GROUP BY 1, 2), sa AS (SELECT seq_id, start AS frame, min(action) AS sample FROM ann GROUP BY 1, 2) SELECT DISTINCT a.seq_id, a.event AS name, fr.frame, sa.sample FROM ann a LEFT JOIN fr ON fr.seq_id = a.seq_id AND fr.name = a.event LEFT JOIN sa ON sa.seq_id = a.seq_id AND sa.frame = fr.frame""")
def b7(s, d):
    ann = annotations(s, d)
    names = ann.select("seq_id", F.col("event").alias("name")).distinct()
    return A.frame_to_sample(names, ann.select("seq_id", F.col("event").alias("name"), F.col("start").alias("frame")), ann.select("seq_id", F.col("start").alias("frame"), F.col("action").alias("sample")))


@query("b8_trim_before_first", with_(ANN, MONTHS) + ", f AS (SELECT seq_id, min(start) AS f FROM ann WHERE action = 7 GROUP BY 1) SELECT seq_id, t FROM months JOIN f USING (seq_id) WHERE t > f")
def b8(s, d):
    return A.trim_before_first(months(s, d), annotations(s, d), 7)


@query("b9_mean_clock", with_(FRAMES, SIGNAL) + "SELECT seq_id, t, round(avg(us) / 1e6, 3) AS seconds FROM sig GROUP BY 1, 2")
def b9(s, d):
    return A.mean_clock(signal(s, d)).select("seq_id", "t", F.round(F.col("us") / 1e6, 3).alias("seconds"))


@query("b10_truncate", with_(FRAMES, SIGNAL) + ", m AS (SELECT seq_id, min(m) AS m FROM (SELECT seq_id, device, max(t) AS m FROM sig GROUP BY 1, 2) GROUP BY 1) SELECT seq_id, device, t, value FROM sig JOIN m USING (seq_id) WHERE t <= m")
def b10(s, d):
    return A.truncate_to_shortest(signal(s, d)).select("seq_id", "device", "t", "value")


CUTOFF = 1_704_100_000_000_000


@query("b11_unmirror", with_(FRAMES) + f"SELECT seq_id, t, CASE WHEN min(us) OVER (PARTITION BY seq_id) < {CUTOFF} THEN -score ELSE score END AS score FROM frames")
def b11(s, d):
    return A.unmirror(frames(s, d), CUTOFF, "score").select("seq_id", "t", "score")


@query("b12_at_keyframes", with_(FRAMES) + "SELECT seq_id, t, label, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY t) - 1 AS INTEGER) AS i FROM frames SEMI JOIN (SELECT DISTINCT seq_id, CAST(t // 2 AS INTEGER) AS t FROM frames WHERE score > 100) USING (seq_id, t)")
def b12(s, d):
    f = frames(s, d)
    return A.at_keyframes(f, f.filter("score > 100").select("seq_id", "t"), 2).select("seq_id", "t", "label", "i")


@query("e1_window_clips", with_(FRAMES) + """SELECT seq_id, t AS anchor, greatest(t - 50, 0) AS start, least(t + 49, m) AS "end", label FROM (SELECT *, max(t) OVER (PARTITION BY seq_id) AS m FROM frames) WHERE t % 10 = 0""")
def e1(s, d):
    return E.window_clips(frames(s, d), 100, 10)


@query("e2_segment_clips", runs_of("big") + """, votes AS (SELECT seq_id, seg_id, x, label, count(*) AS n FROM numbered GROUP BY 1, 2, 3, 4), b AS (SELECT seq_id, seg_id, x, arg_min(label, struct_pack(n := -n, l := label)) AS label FROM votes GROUP BY 1, 2, 3)
 SELECT b.seq_id, b.seg_id, b.x AS big, r.start, r."end", b.label FROM b JOIN runs r ON r.seq_id = b.seq_id AND r.seg_id = b.seg_id""")
def e2(s, d):
    return E.segment_clips(frames(s, d), "big", ["label"])


@query("e3_fixed_windows", with_(FRAMES) + "SELECT seq_id, CAST(t // 16 AS INTEGER) AS win, round(sum(score), 4) AS total, count(*) AS n FROM frames GROUP BY 1, 2")
def e3(s, d):
    return E.fixed_windows(frames(s, d), 16).groupBy("seq_id", "win").agg(F.round(F.sum("score"), 4).alias("total"), F.count("*").alias("n"))


GAPS = "gaps AS (SELECT seq_id, t, CASE WHEN score > 15 THEN floor(score / 20) END AS score FROM frames)"


def _gaps(s, d):
    return frames(s, d).select("seq_id", "t", F.when(F.col("score") > 15, F.floor(F.col("score") / 20).cast("double")).alias("score"))


@query("e4_window_keyframes", with_(FRAMES, GAPS) + "SELECT seq_id, CAST(t // 3 AS INTEGER) AS win, arg_min(t, struct_pack(s := -score, t := t)) AS t FROM gaps WHERE score IS NOT NULL GROUP BY 1, 2")
def e4(s, d):
    return E.window_keyframes(_gaps(s, d), 3)


@query(
    "e5_segment_keyframes",
    runs_of("CAST(score > 30 AS INTEGER)") + """, g AS (SELECT * FROM runs WHERE label = 1 AND n >= 2) SELECT g.seq_id, start, "end", arg_min(f.t, struct_pack(s := -f.score, t := f.t)) AS t FROM g JOIN frames f ON f.seq_id = g.seq_id AND f.t BETWEEN g.start AND g."end" GROUP BY 1, 2, 3""",
)
def e5(s, d):
    return E.segment_keyframes(frames(s, d), 30, 2)


@query(
    "e6_pair_corr",
    with_(FRAMES, SIGNAL, PAIRS) + """, lim AS (SELECT seq_id, d1, d2, max(t) AS m FROM pairs GROUP BY 1, 2, 3),
 near AS (SELECT p.seq_id, p.d1, p.d2, p.t, unnest([-2, -1, 0, 1, 2]) AS o, m FROM pairs p JOIN lim USING (seq_id, d1, d2)),
 spot AS (SELECT *, CASE WHEN t + o < 0 THEN -(t + o) WHEN t + o > m THEN 2 * m - (t + o) ELSE t + o END AS u FROM near)
 SELECT n.seq_id, n.d1, n.d2, n.t, round(sum(p.a * p.b) / (sqrt(sum(p.a * p.a) * sum(p.b * p.b)) + 1e-6), 6) AS corr FROM spot n JOIN pairs p ON p.seq_id = n.seq_id AND p.d1 = n.d1 AND p.d2 = n.d2 AND p.t = n.u WHERE m >= 2 GROUP BY 1, 2, 3, 4""",
)
def e6(s, d):
    from seqloom.operators.signals import device_pairs

    pairs = device_pairs(signal(s, d))
    long = pairs.groupBy("seq_id", "d1", "d2").agg(F.max("t").alias("m")).filter("m >= 2").drop("m")
    return E.pair_corr(pairs.join(long, ["seq_id", "d1", "d2"], "left_semi")).withColumn("corr", F.round("corr", 6))


@query("e7_window_median", with_(FRAMES) + ", w AS (SELECT seq_id, t, list_sort(list(k) OVER (PARTITION BY seq_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS l FROM frames) SELECT seq_id, t, l[(len(l) + 1) // 2] AS label FROM w")
def e7(s, d):
    return E.window_median_label(frames(s, d), 2, "k")


@query("e8_batch_index", with_(FRAMES) + "SELECT seq_id, CAST(unnest(range(0, m + 1, 16)) AS INTEGER) AS win_start FROM (SELECT seq_id, max(t) AS m FROM frames GROUP BY 1)")
def e8(s, d):
    return E.batch_index(frames(s, d), 16)


@query(
    "e9_around_start",
    with_(ANN, MONTHS) + """, w AS (SELECT a.*, greatest(start - 2, 0) AS x, least(start + 2, m - 1) AS y FROM ann a JOIN (SELECT seq_id, max(t) AS m FROM months GROUP BY 1) USING (seq_id))
 SELECT m.seq_id, ann_id, t, t BETWEEN x AND y AS near FROM months m JOIN w ON w.seq_id = m.seq_id AND (t BETWEEN x AND y OR t BETWEEN start AND "end")""",
)
def e9(s, d):
    return E.around_start(months(s, d), annotations(s, d), 2)
