"""Registered queries: interval annotations (C) and run-length segments (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import labels as L
from seqloom.operators import segments as S
from seqloom.plans.inputs import ANN, FRAMES, MONTHS, SCORES, annotations, frames, months, scores, with_
from seqloom.plans.registry import query

RUNS = """flagged AS (SELECT *, CASE WHEN lag(x) OVER (PARTITION BY seq_id ORDER BY t) IS NOT DISTINCT FROM x AND t > 0 THEN 0 ELSE 1 END AS f FROM base),
 numbered AS (SELECT *, CAST(sum(f) OVER (PARTITION BY seq_id ORDER BY t) - 1 AS BIGINT) AS seg_id FROM flagged),
 runs AS (SELECT seq_id, seg_id, x AS label, min(t) AS start, max(t) AS "end", count(*) AS n FROM numbered GROUP BY 1, 2, 3)"""


def runs_of(x: str) -> str:
    """Views up to ``runs`` over the frames' expression x."""
    return with_(FRAMES, f"base AS (SELECT *, {x} AS x FROM frames)", RUNS)


ON = "CAST(score > 50 AS INTEGER)"


@query("d1_segments", runs_of("label") + 'SELECT seq_id, seg_id, label, start, "end", n FROM runs')
def d1(s, d):
    return S.to_segments(frames(s, d)).select("seq_id", "seg_id", "label", "start", "end", "n")


@query("d2_from_segments", with_(FRAMES) + "SELECT seq_id, t, label FROM frames")
def d2(s, d):
    return S.from_segments(S.to_segments(frames(s, d)))


@query("d3_segment_ids", runs_of("label") + "SELECT seq_id, t, seg_id FROM numbered")
def d3(s, d):
    return S.segment_ids(frames(s, d)).select("seq_id", "t", "seg_id")


@query("d4_active_slices", runs_of(ON) + 'SELECT seq_id, start, "end", n FROM runs WHERE label = 1')
def d4(s, d):
    return S.active_slices(frames(s, d), F.col("score") > 50)


SMALL = """kept AS (SELECT *, coalesce(last_value(CASE WHEN n >= {n} THEN label END IGNORE NULLS) OVER (PARTITION BY seq_id ORDER BY seg_id ROWS UNBOUNDED PRECEDING), -1) AS y FROM runs),
 small AS (SELECT seq_id, CAST(unnest(range(start, "end" + 1)) AS INTEGER) AS t, y AS label FROM kept)"""


@query("d5_remove_small_segments", runs_of("big") + ", " + SMALL.format(n=3) + " SELECT seq_id, t, label FROM small")
def d5(s, d):
    return S.remove_small_segments(frames(s, d), 3, "big")


@query(
    "d6_joint_segments",
    runs_of("CAST(score > 90 AS INTEGER) + 2 * CAST(k > 90 AS INTEGER)") + ", " + SMALL.format(n=3)
    + ", f2 AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY seq_id ORDER BY t) = label THEN 0 ELSE 1 END AS f FROM small) SELECT seq_id, t, CAST(sum(f) OVER (PARTITION BY seq_id ORDER BY t) - 1 AS BIGINT) AS seg_id FROM f2",
)
def d6(s, d):
    f = frames(s, d).withColumn("a", (F.col("score") > 90).cast("int")).withColumn("b", (F.col("k") > 90).cast("int"))
    return S.joint_segments(f, ["a", "b"], 3)


@query("d7_reduce_segments", runs_of("label") + "SELECT seq_id, seg_id, round(avg(score), 6) AS mean_score, max(k) AS max_k, count(*) AS n FROM numbered GROUP BY 1, 2")
def d7(s, d):
    return S.reduce_over_segments(S.segment_ids(frames(s, d)), F.round(F.avg("score"), 6).alias("mean_score"), F.max("k").alias("max_k"), F.count("*").alias("n"))


@query("d7_reduce_with_callables", runs_of("label") + "SELECT seq_id, seg_id, max(k) AS max_k, round(max(score) - min(score), 6) AS spread, arg_max(k, t) - arg_min(k, t) AS drift FROM numbered GROUP BY 1, 2")
def d7_callables(s, d):
    """Two reductions written in Python, the second one depending on the order of frames, beside a built-in one."""
    spread, drift = lambda x: x.max() - x.min(), lambda k: k[-1] - k[0]
    x = S.reduce_with(S.segment_ids(frames(s, d)), {"spread": (spread, ["score"]), "drift": (drift, ["k"])}, F.max("k").alias("max_k"))
    return x.select("seq_id", "seg_id", "max_k", F.round("spread", 6).alias("spread"), F.col("drift").cast("int").alias("drift"))


MEANS = "means AS (SELECT seq_id, t, CASE WHEN x = 1 THEN avg(k) OVER (PARTITION BY seq_id, seg_id) ELSE 0 END AS mean FROM numbered)"


@query("d8_slice_means", runs_of(ON) + ", " + MEANS + " SELECT seq_id, t, round(mean, 6) AS mean FROM means")
def d8(s, d):
    return S.slice_means(frames(s, d), F.col("score") > 50, "k").withColumn("mean", F.round("mean", 6))


@query("d9_revise_labels", runs_of(ON) + ", " + MEANS + " SELECT seq_id, t, CAST(mean > 50 AS INTEGER) AS label FROM means")
def d9(s, d):
    return S.revise_labels(frames(s, d), F.col("score") > 50, "k", 50.0)


@query(
    "d10_presegment_scores",
    with_(SCORES, "base AS (SELECT *, CAST(list_max(score) > 0 AS INTEGER) AS x FROM (SELECT seq_id, t, list_transform(score, lambda y: y - 0.1) AS score FROM scores))", RUNS)
    + """, r2 AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY start) - 1 AS sid FROM runs WHERE label = 1 AND n > 1)
 SELECT seq_id, CAST(sid AS INTEGER) AS seg_id, start, "end", class_id, round(avg(v), 6) AS score FROM (SELECT r2.seq_id, sid, start, "end", CAST(unnest(range(0, 10)) AS INTEGER) AS class_id, unnest(b.score) AS v FROM r2 JOIN base b ON b.seq_id = r2.seq_id AND b.t BETWEEN start AND "end") GROUP BY 1, 2, 3, 4, 5""",
)
def d10(s, d):
    f = scores(s, d).withColumn("score", F.transform("score", lambda x: x - 0.1))
    return S.presegment_scores(f, 1).withColumn("score", F.round("score", 6))


@query("d11_nested_segments", runs_of("CAST(score > 30 AND k > 20 AS INTEGER)") + 'SELECT seq_id, start, "end", n FROM runs WHERE label = 1')
def d11(s, d):
    return S.nested_segments(frames(s, d), F.col("score") > 30, F.col("k") > 20)


@query("d12_trim_to_label", with_(FRAMES) + "SELECT seq_id, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY t) - 1 AS INTEGER) AS t, label, score FROM frames WHERE score > 20")
def d12(s, d):
    return S.trim_to_label(frames(s, d), F.col("score") > 20).select("seq_id", "t", "label", "score")


@query("d13_remap_labels", with_(FRAMES) + "SELECT seq_id, t, CASE label WHEN 'click' THEN 'view' WHEN 'view' THEN 'click' ELSE label END AS label FROM frames")
def d13(s, d):
    f = frames(s, d)
    mapping = f.select(F.col("label").alias("old")).distinct().withColumn("new", F.when(F.col("old") == "click", "view").when(F.col("old") == "view", "click"))
    return S.remap_labels(f, mapping.filter("new is not null")).select("seq_id", "t", "label")


HITS = """hits AS (SELECT m.seq_id, m.t, a.* EXCLUDE (seq_id) FROM months m JOIN ann a ON a.seq_id = m.seq_id AND m.t BETWEEN a.start AND a."end")"""
PAINT = with_(ANN, MONTHS, HITS)


@query(
    "c1_paint_labels",
    PAINT + ", top AS (SELECT seq_id, t, arg_max(action, ann_id) AS label, count(*) AS n FROM hits GROUP BY 1, 2) SELECT m.seq_id, m.t, coalesce(label, -1) AS label, coalesce(n, 0) AS n_cover FROM months m LEFT JOIN top USING (seq_id, t)",
)
def c1(s, d):
    return L.paint_labels(months(s, d), annotations(s, d), "action", -1)


@query(
    "c2_paint_parts",
    PAINT + ", top AS (SELECT seq_id, t, max(ann_id) AS a FROM hits GROUP BY 1, 2) SELECT m.seq_id, m.t, coalesce(a % 7 = 1, false) AS body, coalesce(a % 5 = 2, false) AS wheel FROM months m LEFT JOIN top USING (seq_id, t)",
)
def c2(s, d):
    ann = annotations(s, d).withColumn("body", F.col("part1") == 1).withColumn("wheel", F.col("part2") == 2)
    return L.paint_parts(months(s, d), ann, ["body", "wheel"])


@query("c3_action_mask", PAINT + ", top AS (SELECT DISTINCT seq_id, t FROM hits WHERE action <= 7) SELECT m.seq_id, m.t, CASE WHEN top.t IS NULL THEN 1 ELSE 0 END AS mask FROM months m LEFT JOIN top USING (seq_id, t)")
def c3(s, d):
    return L.action_mask(months(s, d), annotations(s, d))


@query(
    "c4_activity_phase",
    with_(ANN, MONTHS) + ', span AS (SELECT seq_id, arg_min(start, ann_id) AS a, arg_max("end", ann_id) AS b FROM ann WHERE action <= 7 GROUP BY 1) SELECT seq_id, t, CASE WHEN t < a THEN 0 WHEN t > b THEN 2 ELSE 1 END AS phase FROM months JOIN span USING (seq_id)',
)
def c4(s, d):
    return L.activity_phase(months(s, d), annotations(s, d))


@query("c5_bin_labels", PAINT + ", top AS (SELECT seq_id, t, arg_max(CAST(part1 // 2 + 1 AS INTEGER), ann_id) AS label FROM hits GROUP BY 1, 2) SELECT m.seq_id, m.t, coalesce(label, 0) AS label FROM months m LEFT JOIN top USING (seq_id, t)")
def c5(s, d):
    ann = annotations(s, d).withColumnRenamed("part1", "part")
    bins = ann.select("part").distinct().withColumn("bin", F.expr("cast(part div 2 + 1 AS int)"))
    return L.bin_labels(months(s, d), ann, bins).drop("n_cover")


@query(
    "c6_pair_labels",
    with_(ANN, MONTHS) + 'SELECT m.seq_id, m.t, least(part1, part2) AS lo, greatest(part1, part2) AS hi, arg_max(action + 1, ann_id) AS label FROM months m JOIN ann a ON a.seq_id = m.seq_id AND m.t >= a.start AND m.t < a."end" GROUP BY 1, 2, 3, 4',
)
def c6(s, d):
    return L.pair_labels(months(s, d), annotations(s, d))


def _objects(s, d):
    ann = annotations(s, d)
    det = ann.select("seq_id", F.col("start").alias("t"), F.substring("event", 3, 100).alias("category"))
    return L.objects_in_interval(ann.select("seq_id", "ann_id", "start", "end"), det).drop("start", "end")


@query(
    "c7_objects_in_interval",
    with_(ANN) + """, det AS (SELECT o_custkey AS seq_id, CAST(floor(datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 30) AS INTEGER) AS t, o_orderpriority AS category FROM orders),
 sets AS (SELECT a.seq_id, a.ann_id, list_sort(list_distinct(list(category))) AS c FROM ann a JOIN det ON det.seq_id = a.seq_id AND det.t BETWEEN a.start AND a."end" GROUP BY 1, 2)
 SELECT a.seq_id, a.ann_id, c[1] AS arg0, c[2] AS arg1, c[3] AS arg2, c[4] AS arg3 FROM ann a LEFT JOIN sets USING (seq_id, ann_id)""",
)
def c7(s, d):
    return _objects(s, d).drop("args")


# the SQL of c7_objects_in_interval has four arguments; here is each whole set
@query(
    "c7_objects_in_interval_all",
    with_(ANN) + """, det AS (SELECT o_custkey AS seq_id, CAST(floor(datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 30) AS INTEGER) AS t, o_orderpriority AS category FROM orders)
 SELECT a.seq_id, a.ann_id, array_to_string(list_sort(list_distinct(list(category))), ',') AS args FROM ann a LEFT JOIN det ON det.seq_id = a.seq_id AND det.t BETWEEN a.start AND a."end" GROUP BY 1, 2""",
)
def c7_all(s, d):
    return _objects(s, d).select("seq_id", "ann_id", F.array_join("args", ",").alias("args"))


@query("c8_parse_event_name", with_(ANN) + "SELECT ann_id, event, CASE WHEN ends_with(event, 'URGENT') THEN 'rush' WHEN starts_with(event, 'P') THEN 'pick' WHEN starts_with(event, 'O') THEN 'attach' END AS action FROM ann")
def c8(s, d):
    rules = [("suffix", "URGENT", "rush"), ("prefix", "P", "pick"), ("prefix", "O", "attach")]
    return L.parse_event_name(annotations(s, d).select("ann_id", "event"), rules)


@query("c9_flag_parts", with_(ANN) + """SELECT ann_id, contains(event, 'HIGH') AS "HIGH", contains(replace(event, 'HIGH', ''), 'LOW') AS "LOW", contains(replace(replace(event, 'HIGH', ''), 'LOW', ''), 'O') AS "O" FROM ann""")
def c9(s, d):
    return L.flag_parts(annotations(s, d).select("ann_id", "event"), ["HIGH", "LOW", "O"]).drop("event")


@query("c10_event_name", """SELECT o_orderkey AS ann_id, o_orderstatus || '(' || array_to_string(list_sort(list_filter([o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN 'base' ELSE '' END], lambda x: x <> '')), ',') || ')' AS name FROM orders""")
def c10(s, d):
    from seqloom.plans.inputs import table

    o = table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("ann_id"), L.event_name(F.col("o_orderstatus"), F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 2 == 0, "base").otherwise("")).alias("name"))


@query("c11_validate_intervals", with_(ANN) + """, len AS (SELECT seq_id, max(start) AS n FROM ann GROUP BY 1) SELECT seq_id, ann_id, CASE WHEN "end" <= start THEN 'empty' ELSE 'past end' END AS reason FROM ann JOIN len USING (seq_id) WHERE "end" <= start OR "end" >= n""")
def c11(s, d):
    ann = annotations(s, d)
    return L.validate_intervals(ann, ann.groupBy("seq_id").agg(F.max("start").alias("n")))


@query(
    "c12_expand_pairs",
    with_(ANN) + """, h AS (SELECT DISTINCT part1, part2, part1 * 10 AS hole1, part2 * 10 + 1 AS hole2 FROM ann WHERE part1 <= part2), hh AS (SELECT * FROM h UNION SELECT part2, part1, hole2, hole1 FROM h)
 SELECT ann_id, part1, part2, hole1, hole2 FROM ann JOIN hh USING (part1, part2)""",
)
def c12(s, d):
    ann = annotations(s, d).select("ann_id", "part1", "part2")
    holes = ann.filter("part1 <= part2").select("part1", "part2", (F.col("part1") * 10).alias("hole1"), (F.col("part2") * 10 + 1).alias("hole2")).distinct()
    return L.expand_pairs(ann, holes)


TOUCH = """touched AS (SELECT seq_id, ann_id, start, unnest([object, target]) AS item FROM ann WHERE action <= 1), first AS (SELECT seq_id, item, arg_min(start, ann_id) AS f FROM touched GROUP BY 1, 2)"""


@query(
    "c13_until_first_touch",
    with_(ANN, MONTHS, TOUCH) + ", items AS (SELECT DISTINCT seq_id, object AS item FROM ann) SELECT m.seq_id, m.t, i.item, CASE WHEN f IS NULL OR m.t < f THEN 1 ELSE 0 END AS in_basket FROM months m JOIN items i USING (seq_id) LEFT JOIN first USING (seq_id, item)",
)
def c13(s, d):
    ann = annotations(s, d)
    return L.until_first_touch(months(s, d), ann, ann.select("seq_id", F.col("object").alias("item")))


@query(
    "c14_resting_devices",
    with_(ANN) + ", dev AS (SELECT DISTINCT seq_id, CAST(unnest(range(0, 7)) AS INTEGER) AS device FROM ann), touched AS (SELECT DISTINCT seq_id, unnest([object, target]) AS device FROM ann) SELECT seq_id, device FROM dev ANTI JOIN touched USING (seq_id, device)",
)
def c14(s, d):
    ann = annotations(s, d)
    devices = ann.select("seq_id").distinct().select("seq_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("device"))
    return L.resting_devices(devices, ann)
