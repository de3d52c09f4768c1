"""Registered queries: vocabularies and assembly states (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import states as G
from seqloom.plans.evaluation import STATES, _states
from seqloom.plans.inputs import ANN, FRAMES, MONTHS, PARTS, annotations, frames, months, part_actions, table, with_
from seqloom.plans.registry import query


def text(c):
    """A state as text, for comparison across engines."""
    return F.concat_ws(",", F.col(c).cast("array<string>")).alias(c)


@query("g1_build_vocab", with_(ANN) + "SELECT event, CAST(row_number() OVER (ORDER BY o, event) - 1 AS INTEGER) AS id FROM (SELECT event, min(ann_id) AS o FROM ann GROUP BY 1)")
def g1(s, d):
    return G.build_vocab(annotations(s, d), "event", "ann_id")


@query("g2_sorted_vocab", with_(FRAMES) + "SELECT label, CAST(row_number() OVER (ORDER BY label) AS INTEGER) AS id FROM (SELECT DISTINCT label FROM frames) UNION ALL SELECT '', 0")
def g2(s, d):
    return G.sorted_vocab(frames(s, d), "label")


@query("g3_compact_vocab", with_(FRAMES) + ", v AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i FROM (SELECT DISTINCT k FROM frames WHERE seq_id < 4)) SELECT seq_id, t, CAST(coalesce(i, (SELECT count(*) FROM v)) AS INTEGER) AS k FROM frames LEFT JOIN v USING (k)")
def g3(s, d):
    f = frames(s, d).select("seq_id", "t", "k")
    return G.compact_vocab(f, f.filter("seq_id < 4"), "k")


@query("g4_cumulative_states", with_(PARTS) + "SELECT seq_id, step, array_to_string(list_sort(list_distinct(list(part) OVER (PARTITION BY seq_id ORDER BY step))), ',') AS state FROM acts")
def g4(s, d):
    return G.cumulative_states(part_actions(s, d)).select("seq_id", "step", text("state"))


# of each part the last operation so far decides
ASM = "last AS (SELECT a.seq_id, a.step, b.part, arg_max(b.op, b.step) AS op FROM acts a JOIN acts b ON a.seq_id = b.seq_id AND b.step <= a.step AND b.op <> 0 GROUP BY 1, 2, 3), asm AS (SELECT a.seq_id, a.step, coalesce(list_sort(list(l.part) FILTER (l.op = 1)), []) AS state FROM acts a LEFT JOIN last l USING (seq_id, step) GROUP BY 1, 2)"


@query("g5_assembly_states", with_(PARTS, ASM) + "SELECT seq_id, step, array_to_string(state, ',') AS state FROM asm")
def g5(s, d):
    return G.assembly_states(part_actions(s, d)).select("seq_id", "step", text("state"))


PREV = ASM + ", pv AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY seq_id ORDER BY step), []) AS before FROM asm)"


def _moves(s, d):
    return G.transition_labels(G.assembly_states(part_actions(s, d)))


@query("g6_transition_labels", with_(PARTS, PREV) + "SELECT seq_id, step, array_to_string(before, ',') AS before, array_to_string(state, ',') AS state FROM pv")
def g6(s, d):
    return _moves(s, d).select("seq_id", "step", text("before"), text("state"))


@query("g7_action_from_transition", with_(PARTS, PREV) + ", df AS (SELECT *, list_filter(list_concat(before, state), lambda x: NOT (list_contains(before, x) AND list_contains(state, x))) AS df FROM pv) SELECT seq_id, step, CASE WHEN len(df) = 1 THEN df[1] END AS part FROM df")
def g7(s, d):
    return _moves(s, d).select("seq_id", "step", G.action_from_transition(F.col("before"), F.col("state")).alias("part"))


@query("g8_signed_difference", with_(PARTS, PREV) + ", df AS (SELECT *, list_filter(before, lambda x: NOT list_contains(state, x)) AS gone, list_filter(state, lambda x: NOT list_contains(before, x)) AS new FROM pv) SELECT seq_id, step, CASE WHEN len(gone) = 0 AND len(new) = 0 THEN 0 WHEN len(gone) = 0 THEN 1 WHEN len(new) = 0 THEN -1 END AS sign, array_to_string(CASE WHEN len(gone) = 0 THEN new ELSE gone END, ',') AS parts FROM df")
def g8(s, d):
    x = _moves(s, d).withColumn("x", G.signed_difference(F.col("before"), F.col("state")))
    return x.select("seq_id", "step", "x.sign", F.col("x.parts").alias("parts")).select("seq_id", "step", "sign", text("parts"))


@query("g9_state_leq", with_(PARTS, PREV) + "SELECT seq_id, step, list_has_all(state, before) AS grows FROM pv")
def g9(s, d):
    return _moves(s, d).select("seq_id", "step", G.state_leq(F.col("before"), F.col("state")).alias("grows"))


@query("g10_union_states", with_(PARTS, PREV) + "SELECT seq_id, step, array_to_string(list_sort(list_distinct(list_concat(before, state))), ',') AS both FROM pv")
def g10(s, d):
    return _moves(s, d).withColumn("both", G.union_states(F.col("before"), F.col("state"))).select("seq_id", "step", text("both"))


@query("g10_conflicting_joints", "SELECT l_partkey AS joint FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag || l_linestatus) > 5")
def g10b(s, d):
    x = table(s, d, "lineitem").select(F.col("l_partkey").alias("joint"), F.concat("l_returnflag", "l_linestatus").alias("attrs"))
    many = x.groupBy("joint").agg(F.count_distinct("attrs").alias("k")).filter("k > 5").select("joint")
    return G.conflicting_joints(x.join(many, "joint", "left_semi"))


@query("g11_equal_upto", with_(PARTS, PREV) + "SELECT seq_id, step, len(list_filter(list_concat(before, state), lambda x: NOT (list_contains(before, x) AND list_contains(state, x)) AND x NOT IN (1, 2, 3))) = 0 AS same FROM pv")
def g11(s, d):
    return _moves(s, d).select("seq_id", "step", G.equal_upto(F.col("before"), F.col("state"), [1, 2, 3]).alias("same"))


@query("g12_symmetry_class", with_(PARTS, ASM) + "SELECT seq_id, step, array_to_string(list_sort(list_transform(state, lambda x: CASE WHEN x IN (1, 2) THEN 100 WHEN x IN (3, 4) THEN 101 ELSE x END)), ',') AS cls FROM asm")
def g12(s, d):
    x = G.assembly_states(part_actions(s, d))
    return x.withColumn("cls", G.symmetry_class(F.col("state"), {1: 100, 2: 100, 3: 101, 4: 101})).select("seq_id", "step", text("cls"))


JOINTS = "jo AS (SELECT DISTINCT l_orderkey AS state_id, CAST(l_partkey % 9 AS INTEGER) AS a, CAST(l_suppkey % 9 AS INTEGER) AS b FROM lineitem WHERE l_partkey % 9 <> l_suppkey % 9)"


def _joint_rows(s, d):
    """The joints, some more than once."""
    li = table(s, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("state_id"), (F.col("l_partkey") % 9).cast("int").alias("a"), (F.col("l_suppkey") % 9).cast("int").alias("b")).filter("a <> b")


def _joints(s, d):
    return _joint_rows(s, d).distinct()


@query("g13_undirected", "WITH " + JOINTS + " SELECT state_id, count(*) AS n FROM (SELECT DISTINCT state_id, least(a, b), greatest(a, b) FROM jo) GROUP BY 1")
def g13(s, d):
    x = _joints(s, d).groupBy("state_id").agg(F.collect_list(F.struct("a", "b")).alias("j"))
    return x.select("state_id", F.size(G.undirected(F.col("j"))).cast("long").alias("n"))


@query("g14_remove_joint", "WITH " + JOINTS + ", f AS (SELECT state_id, min(struct_pack(a := a, b := b)) AS m FROM jo GROUP BY 1) SELECT f.state_id, array_to_string(coalesce(list_sort(list_distinct(list_concat(list(jo.a) FILTER (jo.a IS NOT NULL), list(jo.b) FILTER (jo.b IS NOT NULL)))), []), ',') AS links FROM f LEFT JOIN jo ON jo.state_id = f.state_id AND NOT (jo.a = f.m.a AND jo.b = f.m.b) GROUP BY 1")
def g14(s, d):
    x = _joints(s, d).groupBy("state_id").agg(F.collect_list(F.struct("a", "b")).alias("j")).withColumn("m", F.array_min("j"))
    return x.withColumn("links", G.links_of(G.remove_joint(F.col("j"), F.col("m.a"), F.col("m.b")))).select("state_id", text("links"))


@query(
    "g15_enumerate_states",
    "WITH RECURSIVE " + PARTS + ", " + STATES + ", r(parts) AS (SELECT parts FROM st UNION SELECT list_filter(parts, lambda y: y <> x) FROM (SELECT parts, unnest(parts) AS x FROM r)) SELECT array_to_string(parts, ',') AS parts FROM r",
)
def g15(s, d):
    return G.enumerate_states(_states(s, d)).select(text("parts"))


@query(
    "g16_component_signature",
    "WITH RECURSIVE " + JOINTS + ", e AS (SELECT state_id, a, b FROM jo UNION SELECT state_id, b, a FROM jo), r AS (SELECT state_id, a, a AS b FROM e UNION SELECT r.state_id, r.a, e.b FROM r JOIN e ON r.state_id = e.state_id AND r.b = e.a), v AS (SELECT DISTINCT state_id, a FROM e) SELECT x.state_id, x.a, y.a AS b, CASE WHEN r.a IS NULL THEN -1 ELSE 1 END AS same FROM v x JOIN v y ON x.state_id = y.state_id AND x.a < y.a LEFT JOIN r ON r.state_id = x.state_id AND r.a = x.a AND r.b = y.a",
)
def g16(s, d):
    return G.component_signature(_joint_rows(s, d))


POSES = "WITH RECURSIVE " + JOINTS + """, j AS (SELECT state_id, b AS child, min(a) AS parent FROM jo WHERE a < b GROUP BY 1, 2),
 pose AS (SELECT DISTINCT state_id, parent AS part, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS z FROM j WHERE (state_id, parent) NOT IN (SELECT (state_id, child) FROM j)
 UNION ALL SELECT j.state_id, child, x + 1.0, y + 0.5, z + child FROM pose p JOIN j ON j.state_id = p.state_id AND j.parent = p.part) SELECT * FROM pose"""


@query("g17_propagate_poses", POSES)
def g17(s, d):
    j = _joints(s, d).filter("a < b").groupBy("state_id", F.col("b").alias("child")).agg(F.min("a").alias("parent"))
    j = j.select("state_id", "parent", "child", F.lit(1.0).alias("dx"), F.lit(0.5).alias("dy"), F.col("child").cast("double").alias("dz"))
    roots = j.select("state_id", F.col("parent").alias("part")).join(j.select("state_id", F.col("child").alias("part")), ["state_id", "part"], "left_anti").distinct()
    return G.propagate_poses(roots.select("state_id", "part", *[F.lit(0.0).alias(c) for c in "xyz"]), j)


BRANCHES = "WITH RECURSIVE " + PARTS + """, cl AS (SELECT CAST(p % 3 AS INTEGER) AS cls, CAST(p AS INTEGER) AS part FROM range(0, 8) x(p)),
 way AS (SELECT DISTINCT seq_id, -1 AS step, CAST([] AS INTEGER[]) AS state FROM acts
 UNION ALL SELECT DISTINCT w.seq_id, w.step + 1, CASE op WHEN 1 THEN list_sort(list_append(state, cl.part)) WHEN -1 THEN list_filter(state, lambda x: x <> cl.part) ELSE state END
 FROM way w JOIN acts a ON a.seq_id = w.seq_id AND a.step = w.step + 1 JOIN cl ON cl.cls = a.part % 3 WHERE CASE op WHEN 1 THEN NOT list_contains(state, cl.part) WHEN -1 THEN list_contains(state, cl.part) ELSE true END)
 SELECT seq_id, step, array_to_string(state, ',') AS state FROM way WHERE step >= 0"""


@query("g18_branch_states", BRANCHES)
def g18(s, d):
    acts = part_actions(s, d).select("seq_id", "step", (F.col("part") % 3).alias("cls"), "op")
    classes = s.range(8).select((F.col("id") % 3).cast("int").alias("cls"), F.col("id").cast("int").alias("part"))
    return G.branch_states(acts, classes).select("seq_id", "step", text("state"))


@query("g19_adjacency", "WITH " + JOINTS + " SELECT DISTINCT state_id, least(a, b) AS lo, greatest(a, b) AS hi FROM jo")
def g19(s, d):
    return G.adjacency(_joints(s, d))


@query("g20_edges_to_assembly", with_(FRAMES) + ", p AS (SELECT edges, min(id) AS id FROM (SELECT code * 10 + k % 10 AS edges, t AS id FROM frames WHERE seq_id = 1) GROUP BY 1), m AS (SELECT max(t) AS m FROM frames WHERE seq_id = 1), n AS (SELECT edges, row_number() OVER (ORDER BY edges) AS r FROM (SELECT DISTINCT code * 10 + k % 10 AS edges FROM frames) ANTI JOIN p USING (edges)), x AS (SELECT edges, id FROM p UNION ALL SELECT edges, m + r FROM n, m) SELECT seq_id, t, CAST(id AS INTEGER) AS assembly FROM (SELECT seq_id, t, code * 10 + k % 10 AS edges FROM frames) JOIN x USING (edges)")
def g20(s, d):
    f = frames(s, d).select("seq_id", "t", (F.col("code") * 10 + F.col("k") % 10).alias("edges"))
    return G.edges_to_assembly(f, f.filter("seq_id = 1").select("edges", F.col("t").alias("id"))).select("seq_id", "t", "assembly")


@query("g21_half_open_labels", with_(ANN, MONTHS) + 'SELECT m.seq_id, m.t, coalesce(arg_max(action, ann_id), -1) AS label FROM months m LEFT JOIN ann a ON a.seq_id = m.seq_id AND m.t >= a.start AND m.t < a."end" GROUP BY 1, 2')
def g21(s, d):
    from seqloom.operators.labels import paint_labels

    return paint_labels(months(s, d), annotations(s, d), "action", -1, closed=False).drop("n_cover")


@query("g22_connected_mask", "WITH " + JOINTS + " SELECT DISTINCT o_custkey AS seq_id, o_orderkey AS state_id, unnest([a, b]) AS device FROM orders JOIN jo ON state_id = o_orderkey")
def g22(s, d):
    iv = table(s, d, "orders").select(F.col("o_custkey").alias("seq_id"), F.col("o_orderkey").alias("state_id"), F.col("o_orderkey").alias("start"), F.col("o_orderkey").alias("end"))
    return G.connected_mask(iv, _joints(s, d)).select("seq_id", F.col("start").alias("state_id"), "device")


@query("k18_actions_from_states", with_(PARTS, PREV) + "SELECT count(*) AS n, count(*) FILTER (before = state) AS n_none FROM pv")
def k18(s, d):
    x = _moves(s, d).withColumn("x", G.signed_difference(F.col("before"), F.col("state")))
    return x.agg(F.count("*").alias("n"), F.sum((F.col("x.sign") == 0).cast("long")).alias("n_none"))
