"""Registered queries: decoders (L, K14) and pixel tables (M)."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from seqloom.functions import arrays as X
from seqloom.operators import decode as L
from seqloom.operators import metrics as K
from seqloom.operators import pixels as M
from seqloom.plans.assemblies import ASM
from seqloom.plans.inputs import FRAMES, PARTS, SCORES, frames, part_actions, scores, table, with_
from seqloom.plans.registry import query
from seqloom.storage import shared_folder, stored


def _moves(s, d):
    return L.log_matrix(scores(s, d), "label", 10, diagonal=5.0)


#: Log moves with the diagonal 5 as in ``_moves``, and frames with their place and their sequence's length.
MOVES = """tr AS (SELECT label AS a, lead(label) OVER (PARTITION BY seq_id ORDER BY t) AS b FROM scores), seen AS (SELECT a, b, count(*) AS n FROM tr WHERE b IS NOT NULL GROUP BY 1, 2),
 cell AS (SELECT i, j, coalesce(n, 0) + CASE WHEN i = j THEN 5.0 ELSE 0.0 END AS m FROM range(0, 10) x(i) CROSS JOIN range(0, 10) y(j) LEFT JOIN seen ON a = i AND b = j),
 line AS (SELECT i, list(CASE WHEN m > 0 THEN greatest(ln(m / s), -20.0) ELSE -20.0 END ORDER BY j) AS r FROM (SELECT *, sum(m) OVER (PARTITION BY i) AS s FROM cell) GROUP BY 1),
 mv AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM line),
 fr AS MATERIALIZED (SELECT seq_id, t, score, label, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY t) - 1 AS INTEGER) AS i, count(*) OVER (PARTITION BY seq_id) AS n FROM scores)"""


def _path(beam="", edge=""):
    """SQL of the best path: forward steps (best score and where it came from for each class), then back from the last frame."""
    now = "f.best" if not beam else f"list_transform(f.best, lambda v: CASE WHEN v >= list_max(f.best) - {beam} THEN v ELSE CAST('-infinity' AS DOUBLE) END)"
    reach = f"list_transform(range(0, 10), lambda j: now[j + 1] + m[j + 1][k + 1]{edge})"
    return f"""fw AS (SELECT seq_id, i, list_transform(range(0, 10), lambda k: CASE WHEN k = 0 THEN CAST(0 AS DOUBLE) ELSE CAST('-infinity' AS DOUBLE) END) AS best, CAST([] AS BIGINT[]) AS came FROM fr WHERE i = 0
 UNION ALL SELECT seq_id, i, list_transform(range(0, 10), lambda k: list_max({reach}) + score[k + 1]), list_transform(range(0, 10), lambda k: list_position({reach}, list_max({reach})) - 1)
 FROM (SELECT r.seq_id, r.i, r.score, r.label, {now} AS now, m FROM fw f JOIN fr r ON r.seq_id = f.seq_id AND r.i = f.i + 1, mv)),
 bw AS (SELECT f.seq_id, f.i, CAST(list_position(best, list_max(best)) - 1 AS BIGINT) AS pred, came FROM fw f JOIN fr r ON r.seq_id = f.seq_id AND r.i = f.i WHERE f.i = n - 1
 UNION ALL SELECT f.seq_id, f.i, b.came[b.pred + 1], f.came FROM bw b JOIN fw f ON f.seq_id = b.seq_id AND f.i = b.i - 1),
 path AS (SELECT r.seq_id, r.t, CAST(pred AS INTEGER) AS pred, r.label FROM bw b JOIN fr r ON r.seq_id = b.seq_id AND r.i = b.i)"""


#: Log-sum-exp, the forward and the backward recursion, and posteriors at their largest.
LSE = "list_max({0}) + ln(list_sum(list_transform({0}, lambda v: exp(v - list_max({0})))))"
AHEAD = LSE.format("list_transform(range(0, 10), lambda j: f.a[j + 1] + m[j + 1][k + 1])")
BACK = LSE.format("list_transform(range(0, 10), lambda j: m[k + 1][j + 1] + (r2.score[j + 1] + f.b[j + 1]))")
POSTERIOR = f"""fw AS (SELECT seq_id, i, score AS a FROM fr WHERE i = 0
 UNION ALL SELECT r.seq_id, r.i, list_transform(range(0, 10), lambda k: {AHEAD} + r.score[k + 1]) FROM fw f JOIN fr r ON r.seq_id = f.seq_id AND r.i = f.i + 1, mv),
 bk AS (SELECT seq_id, i, list_transform(score, lambda v: CAST(0 AS DOUBLE)) AS b FROM fr WHERE i = n - 1
 UNION ALL SELECT r.seq_id, r.i, list_transform(range(0, 10), lambda k: {BACK}) FROM bk f JOIN fr r2 ON r2.seq_id = f.seq_id AND r2.i = f.i JOIN fr r ON r.seq_id = f.seq_id AND r.i = f.i - 1, mv),
 ps AS (SELECT fr.seq_id, fr.t, list_transform(range(0, 10), lambda k: fw.a[k + 1] + bk.b[k + 1]) AS p FROM fr JOIN fw ON fw.seq_id = fr.seq_id AND fw.i = fr.i JOIN bk ON bk.seq_id = fr.seq_id AND bk.i = fr.i)
 SELECT seq_id, t, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS pred, round(list_max(p) - ({LSE.format("p")}), 6) AS log_prob FROM ps"""
HEAD = "WITH RECURSIVE " + ", ".join([SCORES, MOVES]) + ", "
MATCHED = "WITH RECURSIVE " + FRAMES + """, a AS (SELECT seq_id, list(t ORDER BY t) AS x FROM frames WHERE score > 100 GROUP BY 1), b AS (SELECT seq_id, list(t ORDER BY t) AS y FROM frames WHERE k > 80 GROUP BY 1),
 ab AS (SELECT seq_id, coalesce(x, []) AS x, coalesce(y, []) AS y FROM a FULL JOIN b USING (seq_id)),
 io AS MATERIALIZED (SELECT seq_id, len(x) AS nx, len(y) AS ny, CASE WHEN len(x) > len(y) THEN y ELSE x END AS s, CASE WHEN len(x) > len(y) THEN x ELSE y END AS l FROM ab),
 dp AS (SELECT seq_id, 0 AS j, list_transform(range(0, len(s) + 1), lambda i: CASE WHEN i = 0 THEN CAST(0 AS DOUBLE) ELSE CAST('infinity' AS DOUBLE) END) AS best FROM io
 UNION ALL SELECT io.seq_id, d.j + 1, list_transform(range(0, len(s) + 1), lambda i: CASE WHEN i = 0 THEN CAST(0 AS DOUBLE) ELSE least(d.best[i + 1], d.best[i] + abs(s[i] - l[d.j + 1])) END) FROM dp d JOIN io ON io.seq_id = d.seq_id WHERE d.j < len(l))
 SELECT io.seq_id, len(s) AS matched, best[len(s) + 1] AS cost, nx - len(s) AS false_alarms, ny - len(s) AS misses FROM dp JOIN io ON io.seq_id = dp.seq_id AND dp.j = len(l)"""


@query("l1_viterbi", HEAD + _path() + " SELECT seq_id, t, pred FROM path")
def l1(s, d):
    return L.viterbi(scores(s, d), np.maximum(_moves(s, d), -20.0)).drop("reason")


@query("l2_uniform_decode", with_(SCORES) + "SELECT seq_id, t, CAST(list_position(score, list_max(score)) - 1 AS INTEGER) AS pred FROM scores")
def l2(s, d):
    return L.viterbi(scores(s, d), L.log_matrix(scores(s, d), "label", 10, "uniform"), start=None).drop("reason")


@query("l3_beam_decode", HEAD + _path(beam="5.0") + " SELECT seq_id, t, pred FROM path")
def l3(s, d):
    return L.viterbi(scores(s, d), np.maximum(_moves(s, d), -20.0), beam=-5.0).drop("reason")


@query("l4_marginals", HEAD + POSTERIOR)
def l4(s, d):
    return L.marginals(scores(s, d), np.maximum(_moves(s, d), -20.0)).drop("reason").withColumn("log_prob", F.round("log_prob", 6))


@query("l5_edge_scores", HEAD + _path(edge=" + CASE WHEN j = label % 10 AND k = (label + 1) % 10 THEN 1.0 ELSE 0.0 END") + " SELECT seq_id, t, pred FROM path")
def l5(s, d):
    x = scores(s, d)
    edges = x.select("seq_id", "t", (F.col("label") % 10).alias("src"), ((F.col("label") + 1) % 10).alias("dst"), F.lit(1.0).alias("s"))
    return L.viterbi_with_edges(x, edges, np.maximum(_moves(s, d), -20.0)).drop("reason")


#: Best score of each (segments before, class) as one list of 80, where it came from, and the path back. ``stay`` wins over ``enter`` of equal score.
SEGMENTAL = """, fw AS (SELECT seq_id, i, list_transform(range(0, 80), lambda q: CASE WHEN q < 10 THEN score[q + 1] ELSE CAST('-infinity' AS DOUBLE) END) AS best, CAST([] AS BIGINT[]) AS came FROM fr WHERE i = 0
 UNION ALL SELECT seq_id, i, list_transform(range(0, 80), lambda q: greatest(old[q + 1], inn[q + 1]) + score[q % 10 + 1]),
  list_transform(range(0, 80), lambda q: CASE WHEN inn[q + 1] > old[q + 1] THEN list_position(list_transform(range(0, 10), lambda j: CASE WHEN j = q % 10 THEN CAST('-infinity' AS DOUBLE) ELSE old[q - q % 10 - 10 + j + 1] - 0.05 END), inn[q + 1]) - 1 + q - q % 10 - 10 ELSE q END)
 FROM (SELECT r.seq_id, r.i, r.score, f.best AS old, list_transform(range(0, 80), lambda q: CASE WHEN q < 10 THEN CAST('-infinity' AS DOUBLE) ELSE list_max(list_transform(range(0, 10), lambda j: CASE WHEN j = q % 10 THEN CAST('-infinity' AS DOUBLE) ELSE f.best[q - q % 10 - 10 + j + 1] - 0.05 END)) END) AS inn
  FROM fw f JOIN fr r ON r.seq_id = f.seq_id AND r.i = f.i + 1)),
 bw AS (SELECT f.seq_id, f.i, list_position(best, list_max(best)) - 1 AS q, came FROM fw f JOIN fr r ON r.seq_id = f.seq_id AND r.i = f.i WHERE f.i = n - 1
 UNION ALL SELECT f.seq_id, f.i, b.came[b.q + 1], f.came FROM bw b JOIN fw f ON f.seq_id = b.seq_id AND f.i = b.i - 1)
 SELECT r.seq_id, r.t, CAST(q % 10 AS INTEGER) AS pred FROM bw b JOIN fr r ON r.seq_id = b.seq_id AND r.i = b.i"""
FR = SCORES + """, fr AS MATERIALIZED (SELECT seq_id, t, score, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY t) - 1 AS INTEGER) AS i, count(*) OVER (PARTITION BY seq_id) AS n FROM scores)"""


@query("l6_segmental_decode", "WITH RECURSIVE " + FR + SEGMENTAL)
def l6(s, d):
    return L.segmental_decode(scores(s, d), np.full((10, 10), -0.05), 8).drop("reason")


def _durations():
    return np.log(np.array([[0.1, 0.2, 0.3, 0.2, 0.1, 0.1]] * 10))


def _timed(k, moves, wide="score", first="0"):
    """SQL of models with explicit durations over ``k`` states: ``hs`` holds what the last six frames left, less the running sum of scores.

    ``fw`` has for each number of frames read the best score of a segment's end, how long it lasted and where the next one comes from.
    """
    each = lambda body, v="c": f"list_transform(range(0, {k}), lambda {v}: {body})"
    return f""", du AS (SELECT [ln(0.1), ln(0.2), ln(0.3), ln(0.2), ln(0.1), ln(0.1)] AS d), mm AS MATERIALIZED (SELECT {each(each(moves), "j")} AS m),
 wd AS MATERIALIZED (SELECT seq_id, t, i, n, {each(wide)} AS x FROM fr), hd AS (SELECT {each(f"CAST({first} AS DOUBLE)")} AS h)"""


def _sums(k):
    """SQL of the sums forwards (``fs``: entry scores less running sums) and backwards (``bs``: what follows plus running sums), and of each frame's state probabilities ``pr``."""
    each = lambda body, v="c": f"list_transform(range(0, {k}), lambda {v}: {body})"
    lse = lambda x: f"(CASE WHEN list_max({x}) > CAST('-infinity' AS DOUBLE) THEN list_max({x}) + ln(list_sum(list_transform({x}, lambda v: exp(v - list_max({x}))))) ELSE CAST('-infinity' AS DOUBLE) END)"
    spans = "list_transform(range(0, len(hs)), lambda e: hs[e + 1][c + 1] + d[e + 1])"
    ends = each(f"s[c + 1] + {lse(spans)}")
    into = each(lse(f"list_transform(range(0, {k}), lambda j: y[j + 1] + m[j + 1][c + 1])"))
    begin = each(f"{lse(spans)} - s[c + 1]")
    outof = each(lse(f"list_transform(range(0, {k}), lambda j: m[c + 1][j + 1] + y[j + 1])"))
    return f""", cs AS MATERIALIZED (SELECT seq_id, i + 1 AS i, n, list(v ORDER BY c) AS s FROM (SELECT seq_id, i, n, c, sum(v) OVER (PARTITION BY seq_id, c ORDER BY i) AS v FROM (SELECT seq_id, i, n, unnest(x) AS v, unnest(range(0, {k})) AS c FROM wd)) GROUP BY 1, 2, 3),
 fs AS (SELECT seq_id, CAST(0 AS INTEGER) AS i, h, [h] AS hs, CAST([] AS DOUBLE[]) AS y FROM cs, hd WHERE i = 1
 UNION ALL SELECT seq_id, i, {each("en[c + 1] - s[c + 1]")}, list_prepend({each("en[c + 1] - s[c + 1]")}, hs)[1:6], y FROM (SELECT *, {into} AS en FROM (SELECT c.seq_id, c.i, c.s, f.hs, {ends.replace("s[c + 1] +", "c.s[c + 1] +").replace("hs[", "f.hs[").replace("len(hs)", "len(f.hs)")} AS y FROM fs f JOIN cs c ON c.seq_id = f.seq_id AND c.i = f.i + 1, du), mm)),
 tot AS MATERIALIZED (SELECT f.seq_id, {lse("y")} AS z FROM fs f JOIN cs c ON c.seq_id = f.seq_id AND c.i = f.i WHERE c.i = c.n),
 bs AS (SELECT seq_id, i, s AS h, [s] AS hs FROM cs WHERE i = n
 UNION ALL SELECT seq_id, i, {each("fo[c + 1] + s[c + 1]")}, list_prepend({each("fo[c + 1] + s[c + 1]")}, hs)[1:6] FROM (SELECT *, {outof} AS fo FROM (SELECT c.seq_id, c.i, c.s, b.hs, {begin.replace("s[c + 1]", "c.s[c + 1]").replace("hs[", "b.hs[").replace("len(hs)", "len(b.hs)")} AS y FROM bs b JOIN cs c ON c.seq_id = b.seq_id AND c.i = b.i - 1, du), mm)),
 sg AS (SELECT f.seq_id, f.i AS a, b.i AS b, {each("exp(f.h[c + 1] + d[b.i - f.i] + b.h[c + 1] - z)")} AS w FROM fs f JOIN bs b ON b.seq_id = f.seq_id AND b.i > f.i AND b.i <= f.i + 6 JOIN tot ON tot.seq_id = f.seq_id, du),
 pr AS (SELECT fr.seq_id, fr.t, c, sum(p) AS p FROM (SELECT seq_id, a, b, unnest(w) AS p, unnest(range(0, {k})) AS c FROM sg) JOIN fr USING (seq_id) WHERE fr.i >= a AND fr.i < b GROUP BY 1, 2, 3)"""


APART = "CASE WHEN j = c THEN CAST('-infinity' AS DOUBLE) ELSE -ln(9) END"
LASTING = """, fw AS (SELECT seq_id, CAST(0 AS INTEGER) AS i, list_transform(range(0, 10), lambda c: CAST(0 AS DOUBLE)) AS s, [h] AS hs, CAST([] AS DOUBLE[]) AS best, CAST([] AS BIGINT[]) AS lasted, CAST([] AS BIGINT[]) AS src FROM wd, hd WHERE i = 0
 UNION ALL SELECT seq_id, i, s, list_prepend(list_transform(range(0, 10), lambda c: list_max(list_transform(range(0, 10), lambda j: best[j + 1] + m[j + 1][c + 1])) - s[c + 1]), hs)[1:6], best, lasted,
  list_transform(range(0, 10), lambda c: list_position(list_transform(range(0, 10), lambda j: best[j + 1] + m[j + 1][c + 1]), list_max(list_transform(range(0, 10), lambda j: best[j + 1] + m[j + 1][c + 1]))) - 1)
 FROM (SELECT seq_id, i, s, hs, list_transform(range(0, 10), lambda c: s[c + 1] + list_max(list_transform(range(0, len(hs)), lambda e: hs[e + 1][c + 1] + d[e + 1]))) AS best,
   list_transform(range(0, 10), lambda c: list_position(list_transform(range(0, len(hs)), lambda e: hs[e + 1][c + 1] + d[e + 1]), list_max(list_transform(range(0, len(hs)), lambda e: hs[e + 1][c + 1] + d[e + 1])))) AS lasted
  FROM (SELECT w.seq_id, w.i + 1 AS i, list_transform(range(0, 10), lambda c: f.s[c + 1] + w.x[c + 1]) AS s, f.hs FROM fw f JOIN wd w ON w.seq_id = f.seq_id AND w.i = f.i), du), mm),
 bw AS (SELECT f.seq_id, f.i, list_position(best, list_max(best)) - 1 AS q, lasted[list_position(best, list_max(best))] AS l FROM fw f JOIN (SELECT DISTINCT seq_id, n FROM wd) e ON e.seq_id = f.seq_id AND e.n = f.i
 UNION ALL SELECT f.seq_id, f.i, q, l FROM (SELECT f.seq_id, f.i, f.src[b.q + 1] AS q, f.lasted[f.src[b.q + 1] + 1] AS l FROM bw b JOIN fw f ON f.seq_id = b.seq_id AND f.i = b.i - b.l WHERE f.i > 0) f)
 SELECT wd.seq_id, wd.t, CAST(q AS INTEGER) AS pred FROM bw JOIN wd ON wd.seq_id = bw.seq_id AND wd.i < bw.i AND wd.i >= bw.i - bw.l"""


@query("l7_duration_decode", "WITH RECURSIVE " + FR + _timed(10, APART, "score[c + 1]") + LASTING)
def l7(s, d):
    return L.duration_decode(scores(s, d), _durations(), np.where(np.eye(10) > 0, -np.inf, -np.log(9)), np.zeros(10)).drop("reason")


LIKELIEST = " SELECT seq_id, t, CAST(arg_max(c, p) AS INTEGER) AS pred, round(ln(max(p)), 6) AS log_prob FROM pr GROUP BY 1, 2"


@query("l7_duration_marginals", "WITH RECURSIVE " + FR + _timed(10, APART, "score[c + 1]") + _sums(10) + LIKELIEST)
def l7_marginals(s, d):
    out = L.duration_decode(scores(s, d), _durations(), np.where(np.eye(10) > 0, -np.inf, -np.log(9)), np.zeros(10), marginal=True)
    return out.select("seq_id", "t", "pred", F.round("log_prob", 6).alias("log_prob"))


@query("l7_self_move_marginals", "WITH RECURSIVE " + FR + _timed(10, "-ln(10)", "score[c + 1]") + _sums(10) + LIKELIEST)
def l7_self_moves(s, d):
    """The same where a state may follow itself."""
    out = L.duration_decode(scores(s, d), _durations(), np.full((10, 10), -np.log(10)), np.zeros(10), marginal=True)
    return out.select("seq_id", "t", "pred", F.round("log_prob", 6).alias("log_prob"))


def _events_to_states(cost=0.0):
    table_ = np.full((10, 4, 4), -np.inf)
    for e in range(10):
        for a in range(4):
            table_[e, a, (a + e) % 4] = -cost * ((a + e) % 4)
    return table_


@query("l8_joint_decode")
def l8(s, d):
    return L.joint_decode(scores(s, d), _durations(), _events_to_states(), np.where(np.arange(4) == 0, 0.0, -np.inf)).drop("reason")


#: State c of the programme is event c // 4 with state c % 4.
JOINT = _timed(40, "CASE WHEN (j % 4 + c // 4) % 4 = c % 4 THEN -0.25 * (c % 4) ELSE CAST('-infinity' AS DOUBLE) END", "score[c // 4 + 1]", "CASE WHEN c // 4 % 4 = c % 4 THEN CAST(-0.25 * (c % 4) AS DOUBLE) ELSE CAST('-infinity' AS DOUBLE) END")


@query("l8_joint_marginals", "WITH RECURSIVE " + FR + JOINT + _sums(40) + ", ev AS (SELECT seq_id, t, arg_max(e, p) AS event FROM (SELECT seq_id, t, c // 4 AS e, sum(p) AS p FROM pr GROUP BY 1, 2, 3) GROUP BY 1, 2), st AS (SELECT seq_id, t, arg_max(e, p) AS state FROM (SELECT seq_id, t, c % 4 AS e, sum(p) AS p FROM pr GROUP BY 1, 2, 3) GROUP BY 1, 2) SELECT seq_id, t, CAST(event AS INTEGER) AS event, CAST(state AS INTEGER) AS state FROM ev JOIN st USING (seq_id, t)")
def l8_marginals(s, d):
    """Event and state of each frame by their own posteriors, where each state has a cost of its own."""
    return L.joint_decode(scores(s, d), _durations(), _events_to_states(0.25), np.where(np.arange(4) == 0, 0.0, -np.inf), True, "each").drop("reason")


@query("l9_experiment", HEAD + _path() + ", acc AS (SELECT seq_id % 5 AS fold, seq_id, avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS a FROM path GROUP BY 1, 2) SELECT fold, round(avg(a), 6) AS accuracy, count(*) AS n FROM acc GROUP BY 1")
def l9(s, d):
    """All folds in one job: decode every sequence, score it, average by fold."""
    x = scores(s, d)
    pred = L.viterbi(x, np.maximum(_moves(s, d), -20.0))
    tied = pred.join(x.select("seq_id", "t", F.col("label").alias("truth")), ["seq_id", "t"]).withColumn("fold", F.col("seq_id") % 5)
    return K.accuracy(tied, "fold", "seq_id").groupBy("fold").agg(F.round(F.avg("accuracy"), 6).alias("accuracy"), F.count("*").alias("n"))


@query("l10_baseline_decode", with_(SCORES) + ", l AS (SELECT seq_id, t // 5 AS seg, unnest(range(0, 10)) AS c, unnest(score) AS s FROM scores), m AS (SELECT seq_id, seg, c, avg(s) AS s FROM l GROUP BY 1, 2, 3) SELECT seq_id, CAST(seg AS INTEGER) AS seg_id, CAST(arg_max(c, s) AS INTEGER) AS pred FROM m GROUP BY 1, 2")
def l10(s, d):
    from seqloom.operators.scores import long_form

    x = scores(s, d)
    segs = long_form(x).withColumn("seg_id", F.expr("cast(t div 5 AS int)")).groupBy("seq_id", "seg_id", "class_id").agg(F.avg("s").alias("s"))
    arr = segs.groupBy("seq_id", "seg_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("class_id", "s"))), lambda v: v["s"]).alias("score"))
    return arr.select("seq_id", "seg_id", X.argmax(F.col("score")).alias("pred"))


@query("k14_match_keyframes", MATCHED)
def k14(s, d):
    f = frames(s, d)
    return L.match_keyframes(f.filter("score > 100").select("seq_id", "t"), f.filter("k > 80").select("seq_id", "t"))


PIX = "px AS (SELECT l_suppkey % 5 AS seq_id, l_orderkey % 20 AS t, CAST(l_partkey % 40 AS INTEGER) AS row, CAST(l_suppkey % 37 AS INTEGER) AS col, l_discount * 10 AS r, l_tax * 10 AS g, l_quantity / 50 AS b, l_extendedprice / 50 AS depth, CAST(l_linenumber % 4 AS INTEGER) AS segment, CAST(l_quantity AS INTEGER) % 6 AS cluster FROM lineitem)"


def _pixels(s, d):
    li = table(s, d, "lineitem")
    return li.select((F.col("l_suppkey") % 5).alias("seq_id"), (F.col("l_orderkey") % 20).alias("t"), (F.col("l_partkey") % 40).cast("int").alias("row"), (F.col("l_suppkey") % 37).cast("int").alias("col"), (F.col("l_discount") * 10).alias("r"), (F.col("l_tax") * 10).alias("g"), (F.col("l_quantity") / 50).alias("b"), (F.col("l_extendedprice") / 50).alias("depth"), (F.col("l_linenumber") % 4).cast("int").alias("segment"), (F.col("l_quantity").cast("int") % 6).alias("cluster"))


def _sizes(df):
    return df.groupBy("seq_id", "t", "segment").agg(F.count("*").alias("n"))


@query("m1_segment_features", "WITH " + PIX + ' SELECT seq_id, t, segment, count(*) AS n, round(avg(row), 5) AS row, round(avg(col), 5) AS col, min(row) AS top, min(col) AS "left", max(row) AS bottom, max(col) AS "right", round(sum(b), 4) AS b FROM px WHERE segment <> 0 GROUP BY 1, 2, 3')
def m1(s, d):
    return M.segment_features(_pixels(s, d), "b").withColumn("row", F.round("row", 5)).withColumn("col", F.round("col", 5)).withColumn("b", F.round("b", 4))


@query("m2_frame_scores", "WITH " + PIX + " SELECT seq_id, t, round(avg(cluster * 0.5 - 1), 6) AS score FROM px WHERE segment <> 0 GROUP BY 1, 2")
def m2(s, d):
    p = _pixels(s, d)
    lut = p.select("cluster").distinct().withColumn("ratio", F.col("cluster") * 0.5 - 1)
    return M.frame_scores(p, lut).withColumn("score", F.round("score", 6))


KEPT = ", nu AS (SELECT seq_id, t, segment, row_number() OVER (PARTITION BY seq_id, t ORDER BY segment) AS new FROM keep) SELECT p.seq_id, p.t, CAST(coalesce(new, 0) AS INTEGER) AS segment, count(*) AS n FROM px p LEFT JOIN nu USING (seq_id, t, segment) GROUP BY 1, 2, 3"


@query("m3_filter_segments", "WITH " + PIX + ", keep AS (SELECT seq_id, t, segment FROM px WHERE segment <> 0 GROUP BY 1, 2, 3 HAVING avg(CAST(r > 5 AS INTEGER)) <= 0.45 AND count(*) >= 64)" + KEPT)
def m3(s, d):
    return _sizes(M.filter_segments(_pixels(s, d), F.col("r") > 5, 0.45, 64))


@query("m4_near_camera", "WITH " + PIX + " SELECT seq_id, t, count(*) FILTER (depth < 500) AS near FROM px GROUP BY 1, 2")
def m4(s, d):
    return _pixels(s, d).groupBy("seq_id", "t").agg(F.sum(M.near_camera("depth").cast("long")).alias("near"))


@query("m5_remove_extreme", "WITH " + PIX + ", ce AS (SELECT seq_id, t, segment, avg(row) * 3 + avg(col) * 4 AS v FROM px WHERE segment <> 0 GROUP BY 1, 2, 3), keep AS (SELECT seq_id, t, segment FROM ce ANTI JOIN (SELECT seq_id, t, arg_max(segment, v) AS segment FROM ce GROUP BY 1, 2) USING (seq_id, t, segment))" + KEPT)
def m5(s, d):
    return _sizes(M.remove_extreme_segment(_pixels(s, d)))


@query("m6_drop_background", "WITH " + PIX + ", keep AS (SELECT seq_id, t, segment FROM px WHERE segment <> 0 GROUP BY 1, 2, 3 HAVING avg(CAST(g > 4 AS INTEGER)) <= 0.5)" + KEPT)
def m6(s, d):
    return _sizes(M.drop_background_segments(_pixels(s, d), F.col("g") > 4))


@query("m7_background_model", "WITH " + PIX + ', m AS (SELECT seq_id, row, col, avg(r) AS mr, avg(b) AS mb FROM px WHERE t < 10 GROUP BY 1, 2, 3) SELECT p.seq_id, p.t, count(*) FILTER (sqrt((r - mr) ** 2 + (b - mb) ** 2) < 0.2) AS n FROM px p LEFT JOIN m USING (seq_id, row, col) GROUP BY 1, 2')
def m7(s, d):
    p = M.background_model(_pixels(s, d), F.col("t") < 10, ["r", "b"])
    return p.groupBy("seq_id", "t").agg(F.sum(F.col("background").cast("long")).alias("n"))


@query("m8_color_model")
def m8(s, d):
    return M.fit_color_model(_pixels(s, d), 6)[1]


@query("m9_frame_snr", "WITH " + PIX + ", f AS (SELECT seq_id, t, count(*) FILTER (cluster IN (0, 1)) / nullif(count(*) FILTER (cluster IN (2, 3)), 0) AS snr FROM px GROUP BY 1, 2) SELECT seq_id, arg_min(t, struct_pack(s := -snr, t := t)) AS t FROM f WHERE snr IS NOT NULL GROUP BY 1")
def m9(s, d):
    return M.best_frame(M.frame_snr(_pixels(s, d), [0, 1], [2, 3]), "snr")


@query("m10_label_pixels", "WITH " + PIX + ", c AS (SELECT *, r * r + g * g + b * b AS d1, (r - 5) ** 2 + (g - 4) ** 2 + (b - 1) ** 2 AS d2 FROM px) SELECT seq_id, t, CASE WHEN segment = 0 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS color, count(*) AS n FROM c GROUP BY 1, 2, 3")
def m10(s, d):
    p = M.label_pixels(_pixels(s, d), [(0, 0, 0), (5, 4, 1)])
    return p.groupBy("seq_id", "t", "color").agg(F.count("*").alias("n"))


# streams: rows arrive in batches and out of order, and the result must be that of the whole table
STEPS = 6


def _arriving(rows, name):
    """A stream of these rows: files written one after the other by time, in ``STEPS`` stretches, a third of each stretch a stretch late, read a few files a batch.

    The watermark allows for rows two stretches late. A last row far ahead ends the stream, as it moves the watermark past all others.
    """
    from seqloom.streaming.online import stream_session

    spark = rows.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    first, last = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    width = max(1_000_000, (last - first) // STEPS + 1) if first is not None else 1_000_000
    late = F.when(F.pmod(F.xxhash64(*rows.columns), F.lit(3)) == 0, 1).otherwise(0)
    dealt = stored(rows.withColumn("_file", (F.expr(f"(unix_micros(ts) - {first or 0}) div {width}") + late).cast("int")))
    files = 4
    for step in range(STEPS + 1):
        dealt.filter(F.col("_file") == step).drop("_file").repartition(files).write.parquet(f"{at}/{name}/{step}")
    blank = {c: F.array().cast(t) if t.startswith("array") else F.lit("0").cast(t) for c, t in rows.dtypes}
    blank |= {"seq_id": F.lit(-ord(name[0])).cast("long"), "ts": F.timestamp_micros(F.lit((last or 0) + 10 * width + 10 * 86_400_000_000))}
    end = spark.range(1).select(*[blank[c].alias(c) for c in rows.columns])
    end.write.parquet(f"{at}/{name}/{STEPS + 1}")
    stream = stream_session(spark).readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{at}/{name}/*")
    return stream.withWatermark("ts", f"{2 * width // 1_000_000 + 1} seconds"), at


def _finished(out, at):
    """The rows that a stream has written once it has read all files."""
    query_ = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query_.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{at}/out")


def _timed_frames(s, d):
    return frames(s, d).withColumn("ts", F.timestamp_micros("us"))


@query("q1_best_event", with_(FRAMES) + ", w AS (SELECT us // 86400000000 AS day, label, score, us FROM frames) SELECT day, arg_max(label, struct_pack(s := score, u := -us)) AS label, max(score) AS score FROM w GROUP BY 1")
def q1(s, d):
    from seqloom.streaming.online import best_event_per_window

    stream, at = _arriving(_timed_frames(s, d).select("seq_id", "ts", "label", "score"), "frames")
    return _finished(best_event_per_window(stream, "1 day").select(F.expr("unix_micros(win.start) div 86400000000").alias("day"), "label", "score"), at)


@query("q2_sliding_correlation", with_(FRAMES) + ", w AS (SELECT CAST(unnest([us // 43200000000 - 1, us // 43200000000]) AS BIGINT) AS half, code, score FROM frames), a AS (SELECT half, avg(score) FILTER (code = 0) AS a, avg(score) FILTER (code = 1) AS b, count(*) AS n FROM w GROUP BY 1) SELECT half, round(a, 5) AS a, round(b, 5) AS b, n FROM a")
def q2(s, d):
    from seqloom.streaming.online import sliding_pair

    stream, at = _arriving(_timed_frames(s, d).select("seq_id", "ts", "code", "score"), "frames")
    return _finished(sliding_pair(stream, 0, 1, "1 day", "12 hours").select(F.expr("unix_micros(win.start) div 43200000000").alias("half"), F.round("a", 5).alias("a"), F.round("b", 5).alias("b"), "n"), at)


@query("q3_activity_sessions", with_(FRAMES) + ", g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY seq_id ORDER BY us) < 14400000000 THEN 0 ELSE 1 END AS f FROM frames), n AS (SELECT *, sum(f) OVER (PARTITION BY seq_id ORDER BY us) AS s FROM g) SELECT seq_id, min(us) AS start_us, count(*) AS n FROM n GROUP BY seq_id, s")
def q3(s, d):
    from seqloom.streaming.online import activity_sessions

    stream, at = _arriving(_timed_frames(s, d).select("seq_id", "ts"), "frames")
    return _finished(activity_sessions(stream, "4 hours").select("seq_id", F.unix_micros("win.start").alias("start_us"), "n"), at)


@query("q4_online_states", with_(PARTS, ASM) + "SELECT seq_id, step, array_to_string(state, ',') AS state FROM asm")
def q4(s, d):
    from seqloom.streaming.online import track_states

    acts = part_actions(s, d).select("seq_id", F.col("step").cast("int").alias("step"), "part", "op").withColumn("ts", F.timestamp_seconds(60 * F.col("step") + 172_800))
    stream, at = _arriving(acts, "actions")
    return _finished(track_states(stream), at).select("seq_id", "step", F.array_join(F.col("state").cast("array<string>"), ",").alias("state"))


FILTERED = f"{POSTERIOR[: POSTERIOR.index(' bk AS (')].rstrip().rstrip(',')} SELECT fr.seq_id, fr.t, CAST(list_position(a, list_max(a)) - 1 AS INTEGER) AS state, round(list_max(a) - ({LSE.format('a')}), 6) AS log_prob FROM fw JOIN fr ON fr.seq_id = fw.seq_id AND fr.i = fw.i"


@query("q5_forward_filter", HEAD + FILTERED)
def q5(s, d):
    from seqloom.streaming.online import forward_filter

    moves = np.maximum(_moves(s, d), -20.0)
    stream, at = _arriving(scores(s, d).select("seq_id", "t", "score").withColumn("ts", F.timestamp_seconds(60 * F.col("t") + 172_800)), "scores")
    return _finished(forward_filter(stream, moves), at).withColumn("log_prob", F.round("log_prob", 6))


@query("q6_bounded_join", with_(FRAMES) + "SELECT a.seq_id, a.t AS click, b.t AS view FROM frames a JOIN frames b ON a.seq_id = b.seq_id AND a.label = 'click' AND b.label = 'view' AND b.us BETWEEN a.us AND a.us + 86400000000")
def q6(s, d):
    """Two streams, each with a watermark of its own."""
    from seqloom.streaming.online import bounded_join

    f = _timed_frames(s, d)
    a, at = _arriving(f.filter("label = 'click'").select("seq_id", "ts", F.col("t").alias("click")), "clicks")
    b, _ = _arriving(f.filter("label = 'view'").select("seq_id", "ts", F.col("t").alias("view")), "views_")
    return _finished(bounded_join(a, b, "1 day").select("seq_id", "click", "view"), at)
