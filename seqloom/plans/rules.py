"""Registered queries: rule tables and relations between states (H9, H14, H16, H19, I16, K8, K9, guards)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import counts as H
from seqloom.operators import relations as R
from seqloom.plans.assemblies import JOINTS, _joint_rows, _joints
from seqloom.plans.evaluation import STATES, _states
from seqloom.plans.inputs import ANN, MONTHS, PARTS, annotations, months, part_actions, table, with_
from seqloom.plans.registry import query


@query("h9_one_block_transitions", with_(PARTS, STATES) + ", p AS (SELECT a.state_id AS src, b.state_id AS dst, list_filter(b.parts, lambda x: NOT list_contains(a.parts, x)) AS new FROM st a JOIN st b ON list_has_all(b.parts, a.parts) AND len(b.parts) > len(a.parts)) SELECT src, dst, round(1.0 / count(*) OVER (PARTITION BY src), 6) AS prob FROM p WHERE len(list_filter(new, lambda x: x % 4 = new[1] % 4)) = len(new)")
def h9(s, d):
    return R.one_block_transitions(_states(s, d), 4).withColumn("prob", F.round("prob", 6))


@query("h14_expand_event_rules", with_(ANN) + ", r AS (SELECT event, min(part1) AS a, max(part2) AS b FROM ann GROUP BY 1), m AS (SELECT event, unnest(['leg1', 'leg2']) AS x, b FROM r WHERE a < 9) SELECT event, x AS first, y AS second FROM m, (SELECT unnest(['side', 'top']) AS y)")
def h14(s, d):
    events = annotations(s, d).select("event").distinct()
    rules = events.select("event", F.array(F.array(F.lit("*leg")), F.array(F.lit("top"), F.lit("side"))).alias("parts"))
    cats = s.range(1).select(F.lit("leg").alias("category"), F.explode(F.array(F.lit("leg1"), F.lit("leg2"))).alias("member"))
    slots = H.expand_event_rules(rules, cats)
    return slots.groupBy("event", "mode").agg(F.max(F.when(F.col("slot") == 0, F.col("part"))).alias("first"), F.max(F.when(F.col("slot") == 1, F.col("part"))).alias("second")).drop("mode")


@query(
    "h16_event_state_scores",
    with_(PARTS, STATES) + ", pairs AS (SELECT p.joint, a.state_id AS src, b.state_id AS dst, list_contains(a.parts, p.joint) AS c, list_contains(b.parts, p.joint) AS n FROM (SELECT DISTINCT unnest(parts) AS joint FROM st) p, st a, st b) SELECT joint AS event, src, dst, round(ln(CASE WHEN n THEN 0.75 ELSE 0.25 END), 6) AS s FROM pairs WHERE NOT c",
)
def h16(s, d):
    conn = H.state_connections(_states(s, d))
    joints = conn.select("joint").distinct()
    modes = joints.select(F.col("joint").alias("event"), F.lit(0).alias("mode"), "joint")
    moves = joints.select(F.col("joint").alias("event"), F.explode(F.array(F.struct(F.lit(0).alias("src"), F.lit(1).alias("dst"), F.lit(0.75).alias("value")), F.struct(F.lit(0).alias("src"), F.lit(0).alias("dst"), F.lit(0.25).alias("value")))).alias("m")).select("event", "m.*")
    return H.event_state_scores(modes, conn, moves).select("event", "src", "dst", F.round("s", 6).alias("s"))


@query(
    "h19_action_gaussians",
    with_(ANN, MONTHS) + ", w AS (SELECT a.action AS cls, (m.t * 7) % 11 AS x, (m.t * 5) % 13 AS y FROM months m JOIN ann a ON a.seq_id = m.seq_id AND m.t BETWEEN greatest(a.start - 2, 0) AND a.start + 2 JOIN (SELECT seq_id, max(t) AS m FROM months GROUP BY 1) l ON l.seq_id = m.seq_id AND m.t <= l.m - 1) SELECT cls, count(*) AS n, round(avg(x), 6) AS mx, round(avg(y), 6) AS my, round(var_pop(x), 6) AS vx, round(var_pop(y), 6) AS vy FROM w GROUP BY 1",
)
def h19(s, d):
    from seqloom.operators.clips import around_start

    ann, m = annotations(s, d), months(s, d)
    near = around_start(m, ann, 2).filter("near").join(ann.select("seq_id", "ann_id", F.col("action").alias("cls")), ["seq_id", "ann_id"])
    pts = near.select("cls", ((F.col("t") * 7) % 11).cast("double").alias("x"), ((F.col("t") * 5) % 13).cast("double").alias("y"))
    return H.fit_gaussians(pts).select("cls", "n", *[F.round(c, 6).alias(c) for c in ("mx", "my", "vx", "vy")])


COMPONENT_SCORES = "WITH RECURSIVE " + JOINTS + """, e AS (SELECT state_id, a, b FROM jo UNION SELECT state_id, b, a FROM jo), reach AS (SELECT state_id, a, a AS b FROM e UNION SELECT r.state_id, r.a, e.b FROM reach r JOIN e ON e.state_id = r.state_id AND e.a = r.b),
 v AS (SELECT DISTINCT state_id, a FROM e), sig AS (SELECT x.state_id, x.a, y.a AS b, CASE WHEN r.b IS NULL THEN -1 ELSE 1 END AS same FROM v x JOIN v y ON x.state_id = y.state_id AND x.a < y.a LEFT JOIN reach r ON r.state_id = x.state_id AND r.a = x.a AND r.b = y.a),
 f AS (SELECT l_orderkey AS state_id, least(l_partkey % 9, l_suppkey % 9) AS a, greatest(l_partkey % 9, l_suppkey % 9) AS b, l_quantity AS value FROM lineitem),
 s AS (SELECT state_id, sum(same * (value / 100)) AS s FROM sig JOIN f USING (state_id, a, b) GROUP BY 1)
 SELECT state_id, round(s, 6) AS s, round(s - ln(sum(exp(s)) OVER ()), 6) AS log_prob FROM s"""


@query("i16_component_state_scores", COMPONENT_SCORES)
def i16(s, d):
    feats = table(s, d, "lineitem").select(F.col("l_orderkey").alias("state_id"), (F.col("l_partkey") % 9).cast("int").alias("a"), (F.col("l_suppkey") % 9).cast("int").alias("b"), (F.col("l_quantity") / 100).alias("value"))
    return R.joint_state_scores(_joint_rows(s, d), feats).withColumn("s", F.round("s", 6)).withColumn("log_prob", F.round("log_prob", 6))


FRAME_STATES = "WITH RECURSIVE " + JOINTS + """, e AS (SELECT state_id, a, b FROM jo UNION SELECT state_id, b, a FROM jo), reach AS (SELECT state_id, a, a AS b FROM e UNION SELECT r.state_id, r.a, e.b FROM reach r JOIN e ON e.state_id = r.state_id AND e.a = r.b),
 u AS (SELECT min(state_id) AS state_id, pairs FROM (SELECT state_id, list(struct_pack(a := a, b := b) ORDER BY a, b) FILTER (a < b) AS pairs FROM reach GROUP BY 1) GROUP BY pairs),
 sp AS (SELECT state_id, p.a AS a, p.b AS b FROM (SELECT state_id, unnest(pairs) AS p FROM u)),
 f AS (SELECT c_nationkey AS seq_id, {t} AS t, least(l_partkey % 9, l_suppkey % 9) AS a, greatest(l_partkey % 9, l_suppkey % 9) AS b, sum(l_quantity - 25) AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
 w AS (SELECT seq_id, t, sum(value) AS whole FROM f GROUP BY 1, 2),
 i AS (SELECT seq_id, t, state_id, sum(value) AS inside FROM f JOIN sp USING (a, b) GROUP BY 1, 2, 3),
 s AS (SELECT w.seq_id, w.t, u.state_id, (2 * coalesce(inside, 0) - whole) / 1000 AS s FROM w CROSS JOIN u LEFT JOIN i ON i.seq_id = w.seq_id AND i.t = w.t AND i.state_id = u.state_id),
 """


def _frame_scores(s, d, t):
    """Features are whole numbers, so that ties don't depend on the order of addition."""
    from seqloom.operators.states import component_signature

    li, o, c = table(s, d, "lineitem"), table(s, d, "orders"), table(s, d, "customer")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    a, b = (F.col("l_partkey") % 9).cast("int"), (F.col("l_suppkey") % 9).cast("int")
    features = rows.groupBy(F.col("c_nationkey").alias("seq_id"), t.alias("t"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.sum(F.col("l_quantity") - 25).alias("value"))
    return R.FrameScores(features, R.distinct_signatures(component_signature(_joints(s, d))), scale=0.001)


@query("i16_frame_state_scores", FRAME_STATES.replace("{t}", "CAST(year(o_orderdate) AS INTEGER)") + "m AS (SELECT seq_id, t, ln(sum(exp(s))) AS norm FROM s GROUP BY 1, 2) SELECT seq_id, t, state_id, round(s, 6) AS s, round(s - norm, 6) AS log_prob FROM s JOIN m USING (seq_id, t)")
def i16_frames(s, d):
    """Every year of a nation against every different component structure of the orders."""
    return _frame_scores(s, d, F.year("o_orderdate")).all().withColumn("s", F.round("s", 6)).withColumn("log_prob", F.round("log_prob", 6))


@query("i16_best_states", FRAME_STATES.replace("{t}", "CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER)") + "m AS (SELECT seq_id, t, max(s) AS s, ln(sum(exp(s))) AS norm FROM s GROUP BY 1, 2) SELECT seq_id, t, round(m.s, 6) AS s, min(state_id) AS state_id, round(m.s - any_value(norm), 6) AS log_prob FROM s JOIN m USING (seq_id, t) WHERE s.s = m.s GROUP BY seq_id, t, m.s")
def i16_best(s, d):
    """The best component structure of every month of a nation."""
    x = _frame_scores(s, d, F.year("o_orderdate") * 12 + F.month("o_orderdate")).best()
    return x.withColumn("s", F.round("s", 6)).withColumn("log_prob", F.round("log_prob", 6))


@query("k8_goal_agreement", with_(PARTS) + ", s AS (SELECT seq_id, list_distinct(list(part) FILTER (step % 2 = 0)) AS t, list_distinct(list(part) FILTER (step % 2 = 1)) AS p FROM acts GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (list_has_all([0, 1, 2, 3, 4, 5], coalesce(t, [])) = list_has_all([0, 1, 2, 3, 4, 5], coalesce(p, []))) AS agree FROM s")
def k8(s, d):
    a = part_actions(s, d)
    of = lambda c: F.collect_set(F.when(c, F.col("part")))
    x = a.groupBy("seq_id").agg(of(F.col("step") % 2 == 0).alias("truth"), of(F.col("step") % 2 == 1).alias("pred"))
    return R.goal_agreement(x, [0, 1, 2, 3, 4, 5])


@query("k9_layer_agreement", with_(PARTS) + ", h AS (SELECT DISTINCT seq_id, part // 3 AS layer, part FROM acts), l AS (SELECT seq_id, layer, count(*) AS n, max(layer) OVER (PARTITION BY seq_id) AS top FROM h GROUP BY 1, 2), g AS (SELECT seq_id, top, bool_and(n = CASE layer WHEN 2 THEN 2 ELSE 3 END) FILTER (layer < top) AS ok, count(*) FILTER (layer < top) AS k FROM l GROUP BY 1, 2) SELECT seq_id, coalesce(ok, true) AND k = top AS layers_right FROM g")
def k9(s, d):
    a = part_actions(s, d).select("seq_id", F.expr("cast(part div 3 AS int)").alias("layer"), "part").distinct()
    goal = a.select("layer", "part").distinct()
    return R.layer_agreement(a, goal)


@query("n_assert_all_equal", "SELECT o_custkey AS key, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def guard(s, d):
    return R.not_all_equal(table(s, d, "orders"), "o_custkey", "o_orderstatus").withColumnRenamed("o_custkey", "key")
