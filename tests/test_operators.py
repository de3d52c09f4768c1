"""Hand cases, round trips and brute force."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqloom.functions import arrays as X
from seqloom.operators import align, clips, counts, decode, labels, metrics, relations, segments, signals, states


def frames(spark, values, name="label", seq=1):
    return spark.createDataFrame([(seq, i, v) for i, v in enumerate(values)], f"seq_id long, t int, {name} {'double' if any(isinstance(v, float) for v in values) else 'int'}")


def test_segments_and_back(spark):
    f = frames(spark, [0, 0, 1, 1, 1, 0])
    runs = [(r.start, r.end, r.label) for r in segments.to_segments(f).orderBy("start").collect()]
    assert runs == [(0, 1, 0), (2, 4, 1), (5, 5, 0)]
    back = segments.from_segments(segments.to_segments(f)).orderBy("t").collect()
    assert [r.label for r in back] == [0, 0, 1, 1, 1, 0]


def test_active_slices(spark):
    out = segments.active_slices(frames(spark, [1, 1, 0, 1]), F.col("label") == 1).orderBy("start").collect()
    assert [(r.start, r.end) for r in out] == [(0, 1), (3, 3)]


def test_remove_small_segments(spark):
    f = frames(spark, [0, 1, 1, 0, 1, 1, 2, 2])
    assert [r.label for r in segments.remove_small_segments(f, 2).orderBy("t").collect()] == [-1, 1, 1, 1, 1, 1, 2, 2]
    assert [r.label for r in segments.remove_small_segments(f, 1).orderBy("t").collect()] == [0, 1, 1, 0, 1, 1, 2, 2]


def test_paint_later_wins(spark):
    f = spark.range(6).select(F.lit(1).cast("long").alias("seq_id"), F.col("id").cast("int").alias("t"))
    ann = spark.createDataFrame([(1, 0, 1, 3, "a"), (1, 1, 3, 4, "b")], "seq_id long, ann_id int, start int, end int, name string")
    out = labels.paint_labels(f, ann, "name", "").orderBy("t").collect()
    assert [r.label for r in out] == ["", "a", "a", "b", "b", ""]
    assert [r.n_cover for r in out] == [0, 1, 1, 2, 1, 0]


def test_window_keyframes(spark):
    f = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, 5.0, 5.0, None, None, None, 2.0])], "seq_id long, t int, score double")
    assert [r.t for r in clips.window_keyframes(f, 3).orderBy("t").collect()] == [1, 6]


def test_segment_keyframes(spark):
    f = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.0, 3.0, 4.0, 0.0, 9.0, 0.0, None, 2.0, 1.0])], "seq_id long, t int, score double")
    assert [r.t for r in clips.segment_keyframes(f, 0, 2).orderBy("t").collect()] == [2, 7]


def test_open_ends(spark):
    a = spark.createDataFrame([(1, 0, 10, 0), (1, 1, 25, 30)], "seq_id long, ann_id int, start int, end int")
    assert [r.end for r in align.fill_open_ends(a).orderBy("start").collect()] == [25, 30]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "seq_id long, v double")
    assert [r.seq_id for r in align.drop_invalid_sequences(align.null_if_nan(df), "v").collect()] == [2]


def test_nearest_prefers_earlier(spark):
    s = spark.createDataFrame([(1, 0, 10), (1, 10, 20)], "seq_id long, us long, v int")
    g = spark.createDataFrame([(1, 5), (1, 6), (1, -3)], "seq_id long, us long")
    assert {r.us: r.v for r in align.resample_nearest(s, g, ["seq_id"], ["v"]).collect()} == {5: 10, 6: 20, -3: 10}


def test_pair_diff(spark):
    p = spark.createDataFrame([(1, 0, 1, 0, 100.0, 50.0)], "seq_id long, t int, d1 int, d2 int, a double, b double")
    assert math.isclose(signals.pair_diff(p).first()["diff"], 6.25)


def test_reaching_hand(spark):
    h = spark.createDataFrame([(1, 0, 1.0, None, 2.0, 300.0)], "seq_id long, t int, x1 double, y1 double, x2 double, y2 double")
    r = signals.reaching_hand(h, 250).first()
    assert (r.hx, r.hy) == (2.0, 300.0)


def test_track_pairs_agrees_with_sequential_form(spark):
    rng = np.random.default_rng(1)
    rows = [(1, t, *map(float, rng.normal(size=4))) for t in range(40)]
    h = spark.createDataFrame(rows, "seq_id long, t int, x1 double, y1 double, x2 double, y2 double")
    a = signals.track_pairs(h).orderBy("t").collect()
    b = signals.track_pairs_with_gaps(h).orderBy("t").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_orientation_sample_by_sample(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for device, n in ((0, 50), (1, 1), (2, 9)):
        q, v, x, before = np.array([1.0, 0, 0, 0]), np.zeros(3), np.zeros(3), None
        for i in range(n):
            s, w = 0.05 * i, rng.normal(size=3)
            a = before if i % 7 == 3 else rng.normal(size=3)
            rows.append((1, device, 3 * i, s, *map(float, w), *map(float, a)))
            dt = 0.05 if i else 0.0
            h = 0.5 * dt * w
            q = np.array([q[0] - q[1:] @ h, *(q[0] * h + q[1:] + np.cross(q[1:], h))])
            q /= np.linalg.norm(q)
            world = a + 2 * np.cross(q[1:], np.cross(q[1:], a) + q[0] * a) - np.array([0, 0, 9.81])
            v = np.zeros(3) if i and np.abs(a - before).max() < 0.005 else v + world * dt
            x, before = x + v * dt, a
            want[device, 3 * i] = [*q, *v, *x]
    df = spark.createDataFrame(rows, "seq_id long, device int, t int, s double, gx double, gy double, gz double, ax double, ay double, az double").repartition(3)
    for block in (4, 256):
        out = signals.orientation_track(df, block=block)
        got = {(r.device, r.t): list(r[3:]) for r in out.collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    gap = signals.orientation_track(df.withColumn("gx", F.when(F.col("t") != 12, F.col("gx"))), block=4).filter("device = 0").orderBy("t").collect()
    assert all((r.qw is None) == (r.t >= 12) for r in gap)
    assert signals.orientation_track(df.limit(0)).count() == 0


def test_poses_of_a_long_chain_in_few_rounds(spark, monkeypatch):
    n, written = 10_000, []
    keep = states.stored
    monkeypatch.setattr(states, "stored", lambda df: written.append(1) or keep(df))
    ids = spark.range(n).select(F.lit(1).alias("state_id"), F.xxhash64("id").alias("parent"), F.xxhash64(F.col("id") + 1).alias("child"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(-2.0).alias("dz"))
    root = spark.range(1).select(F.lit(1).alias("state_id"), F.xxhash64("id").alias("part"), *[F.lit(0.0).alias(c) for c in "xyz"])
    out = states.propagate_poses(root, ids)
    r = out.agg(F.count("*").alias("n"), F.max("x").alias("x"), F.sum("z").alias("z")).first()
    assert (r.n, r.x, r.z) == (n + 1, float(n), -float(n * (n + 1))) and len(written) <= 20


def test_poses_by_levels(spark):
    rng = np.random.default_rng(9)
    joints, roots, want = [], [], {}
    for state in range(12):
        spot = {p: tuple(map(float, rng.integers(-5, 5, 3))) for p in range(14)}
        pairs = [(int(a), int(b)) for a, b in rng.integers(0, 14, (14, 2))]
        joints += [(state, a, b, *(v - u for u, v in zip(spot[a], spot[b], strict=True))) for a, b in pairs]
        first = [p for p in (0, 5) if state]
        roots += [(state, p, *spot[p]) for p in first]
        reached, todo = set(first), list(first)
        while todo:
            a = todo.pop()
            new = {b for u, b in pairs if u == a} - reached
            reached |= new
            todo += new
        want |= {(state, p): spot[p] for p in reached}
    j = spark.createDataFrame(joints, "state_id int, parent int, child int, dx double, dy double, dz double")
    r = spark.createDataFrame(roots, "state_id int, part int, x double, y double, z double")
    assert {(x.state_id, x.part): (x.x, x.y, x.z) for x in states.propagate_poses(r, j).collect()} == want
    assert states.propagate_poses(r, j.limit(0)).count() == len(roots)
    odd = spark.createDataFrame([(1, 0, 20, 1.0, 0.0, 0.0), (1, 0, 20, 2.0, 0.0, 0.0)], j.schema)
    with pytest.raises(ValueError, match="differently"):
        states.propagate_poses(r, odd)


def test_python_reductions_beside_aggregates(spark):
    rows = [(1, 0, t, v) for t, v in ((2, 5.0), (0, None), (1, 1.0))] + [(1, 1, 3, None), (2, 0, 0, 4.0)]
    df = spark.createDataFrame(rows, "seq_id long, seg_id int, t int, v double").repartition(3)
    out = segments.reduce_with(df, {"last": (lambda v: v[-1], ["v"]), "gaps": (lambda v: np.isnan(v).sum(), ["v"])}, F.count("*").alias("n"))
    assert {tuple(r) for r in out.select("seq_id", "seg_id", "n", "last", "gaps").collect()} == {(1, 0, 3, 5.0, 1.0), (1, 1, 1, None, 1.0), (2, 0, 1, 4.0, 0.0)}
    assert segments.reduce_with(df.limit(0), {"last": (lambda v: v[-1], ["v"])}).count() == 0
    with pytest.raises(Exception, match="too long for a Python reduction"):
        segments.reduce_with(df, {"last": (lambda v: v[-1], ["v"])}, most_rows=2).collect()


def test_track_pairs_with_gaps_frame_by_frame(spark):
    rng = np.random.default_rng(2)
    rows = []
    for seq, (n, p) in enumerate([(60, 0.2), (60, 0.6), (40, 0.97), (40, 0.0), (1, 0.0), (1, 1.0), (30, 0.5)]):
        for t in range(n):
            a, b = [None if rng.random() < p else (float(rng.integers(0, 4)), float(rng.integers(0, 4))) for _ in range(2)]
            rows.append((seq, 2 * t, *(a or (None, None)), *(b or (float("nan"), 1.0))))
    h = spark.createDataFrame(rows, "seq_id long, t int, x1 double, y1 double, x2 double, y2 double")
    want, last = {}, {}
    for seq, t, *v in rows:
        now = [None if x is None or x != x else (x, y) for x, y in (v[:2], v[2:])]
        before = last.get(seq, [None, None])
        cost = lambda u, w: 0.0 if u is None or w is None else float(np.sqrt((u[0] - w[0]) ** 2 + (u[1] - w[1]) ** 2))
        if cost(now[0], before[1]) + cost(now[1], before[0]) < cost(now[0], before[0]) + cost(now[1], before[1]):
            now = now[::-1]
        last[seq] = [w if u is None else u for u, w in zip(now, before, strict=True)]
        want[seq, t] = tuple(x for p in last[seq] for x in (p or (None, None)))
    for block in (3, 256):
        out = signals.track_pairs_with_gaps(h, block)
        assert {(r.seq_id, r.t): (r.x1, r.y1, r.x2, r.y2) for r in out.collect()} == want
    assert "Python" not in out._jdf.queryExecution().toString()


def test_one_block_transitions_by_pairs(spark):
    rng = np.random.default_rng(6)
    sets = {tuple(sorted(rng.choice(12, rng.integers(0, 7), replace=False).tolist())) for _ in range(150)} | {(), tuple(range(0, 90, 3)), tuple(range(0, 87, 3)), (3,)}
    states_ = spark.createDataFrame([(str(x), list(x)) for x in sets], "state_id string, parts array<int>")
    out = {(r.src, r.dst) for r in relations.one_block_transitions(states_, 3).collect()}
    want = {(str(a), str(b)) for a in sets for b in sets if set(a) < set(b) and len({x % 3 for x in set(b) - set(a)}) == 1}
    assert out == want


def test_assembly_states(spark):
    a = spark.createDataFrame([(1, 0, 7, 1), (1, 1, 8, 1), (1, 2, 7, -1)], "seq_id long, step int, part int, op int")
    assert [r.state for r in states.assembly_states(a).orderBy("step").collect()] == [[7], [7, 8], [8]]


def test_transition_counts(spark):
    out = {(r.src, r.dst): r.prob for r in counts.transition_counts(frames(spark, [0, 0, 1, 0]), "label").collect()}
    assert out == {(0, 0): 0.5, (0, 1): 0.5, (1, 0): 1.0}


def test_hamming_one(spark):
    v = spark.createDataFrame([("a", [0, 0]), ("b", [0, 1]), ("c", [1, 1])], "id string, v array<int>")
    assert {(r.a, r.b) for r in counts.hamming_one(v).collect()} == {("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")}


def test_event_rules(spark):
    rules = spark.createDataFrame([("e", [["*leg"], ["top", "side"]])], "event string, parts array<array<string>>")
    cats = spark.createDataFrame([("leg", "leg1"), ("leg", "leg2")], "category string, member string")
    out = {}
    for r in counts.expand_event_rules(rules, cats).collect():
        out.setdefault(r.mode, {})[r.slot] = r.part
    assert sorted((m[0], m[1]) for m in out.values()) == [("leg1", "side"), ("leg1", "top"), ("leg2", "side"), ("leg2", "top")]


def test_arrays(spark):
    row = spark.range(1).select(
        X.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))).alias("a"), X.prune(F.array(*map(F.lit, [4.0, 4.0, 3.0, 1.0])), 1).alias("p"), X.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("s")
    ).first()
    assert row.a == 1 and row.p == [4.0, 4.0, 3.0, float("-inf")] and np.allclose(row.s, 0.5)


def test_metrics(spark):
    df = spark.createDataFrame([(1, t, 0, 0 if t < 5 else 1) for t in range(10)], "seq_id long, t int, truth int, pred int")
    assert metrics.overlap_score(df).first().overlap == 0.5
    three = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 1, 0), (1, 2, 2, 2)], "seq_id long, t int, truth int, pred int")
    assert math.isclose(metrics.edit_score(three).first().edit, 1 - 1 / 3)
    assert metrics.adjusted_rand(df.withColumn("pred", F.col("truth"))).first().ari == 1.0


def test_best_path_is_the_best():
    rng = np.random.default_rng(0)
    for _ in range(20):
        s, m = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
        value = lambda p: sum(s[t, p[t]] + m[p[t - 1], p[t]] for t in range(1, 5))
        best = max((p for p in itertools.product(range(3), repeat=5) if p[0] == 0), key=value)
        assert tuple(decode.best_path(s, m)) == best
        full = lambda p: value(p) + s[0, p[0]]
        weights = {p: math.exp(full(p)) for p in itertools.product(range(3), repeat=5)}
        total = sum(weights.values())
        post = decode.posterior(s, m)
        for t, j in itertools.product(range(5), range(3)):
            assert math.isclose(math.exp(post[t, j]), sum(w for p, w in weights.items() if p[t] == j) / total, rel_tol=1e-9)


def test_segments_and_durations_against_enumeration():
    rng = np.random.default_rng(2)
    for _ in range(10):
        s, pair = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))

        def value(p):
            return sum(s[t, p[t]] for t in range(5)) + sum(pair[a, b] for a, b in zip(p, p[1:]) if a != b)

        most = 2
        best = max((p for p in itertools.product(range(3), repeat=5) if sum(a != b for a, b in zip(p, p[1:])) < most), key=value)
        assert tuple(decode.best_segments(s, pair, most)) == best
        dur = rng.normal(size=(3, 3))
        moves = np.where(np.eye(3) > 0, -np.inf, pair)

        def timed(p):
            runs = [(k, len(list(g))) for k, g in itertools.groupby(p)]
            if any(n > 3 for _, n in runs):
                return -np.inf
            return sum(s[t, p[t]] for t in range(5)) + sum(dur[k, n - 1] for k, n in runs) + sum(pair[a, b] for (a, _), (b, _) in zip(runs, runs[1:]))

        best = max(itertools.product(range(3), repeat=5), key=timed)
        assert tuple(decode.best_durations(s, dur, moves, np.zeros(3))) == best


def test_match_keyframes(spark):
    p = spark.createDataFrame([(1, 3), (1, 10), (1, 50)], "seq_id long, t int")
    t = spark.createDataFrame([(1, 4), (1, 11)], "seq_id long, t int")
    r = decode.match_keyframes(p, t).first()
    assert (r.matched, r.cost, r.false_alarms, r.misses) == (2, 2.0, 1, 0)


def test_branch_states_of_whole_sequences(spark):
    from seqloom.plans.catalogue import QUERIES
    from seqloom.plans.inputs import part_actions

    sf = "/root/testdata/sf0.001"
    acts = {}
    for r in part_actions(spark, sf).orderBy("seq_id", "step").collect():
        acts.setdefault(r.seq_id, []).append((r.step, r.part % 3, r.op))
    want = set()
    for seq, steps in acts.items():
        now = {frozenset()}
        for k, cls, op in steps:
            members = range(cls, 8, 3)
            if op:
                now = {s | {p} if op == 1 else s - {p} for s in now for p in members if (p in s) == (op == -1)}
            want |= {(seq, k, ",".join(map(str, sorted(s)))) for s in now}
    rows = QUERIES["g18_branch_states"](spark, sf).collect()
    assert len(rows) == len(want) and {(r.seq_id, r.step, r.state) for r in rows} == want
    assert max(r.step for r in rows) > 2


def test_branch_states_of_nothing(spark):
    from seqloom.operators.states import branch_states

    nothing = spark.createDataFrame([], "seq_id long, step int, cls int, op int")
    assert branch_states(nothing, spark.createDataFrame([(0, 0)], "cls int, part int")).count() == 0


def test_hamming_one_reads_all_orders(spark):
    from seqloom.plans.catalogue import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_linenumber", "l_quantity", "l_suppkey").collect()
    vectors = {(r[0] % 4, int(r[1]) % 4, r[2] % 4) for r in rows}
    want = {("".join(map(str, a)), "".join(map(str, b))) for a in vectors for b in vectors if sum(x != y for x, y in zip(a, b)) == 1}
    got = QUERIES["h10_hamming_one_all"](spark, sf).collect()
    assert len(vectors) == 64 and len(got) == len(want) and {(r.a, r.b) for r in got} == want


def test_objects_in_interval_are_all_there(spark):
    from seqloom.operators.labels import objects_in_interval

    events = spark.createDataFrame([(1, 1, 0, 9), (1, 2, 20, 21)], "seq_id long, ann_id long, start int, end int")
    seen = spark.createDataFrame([(1, i, c) for i, c in enumerate("ecabdfa")], "seq_id long, t int, category string")
    rows = {r.ann_id: r for r in objects_in_interval(events, seen).collect()}
    assert rows[1].args == list("abcdef") and [rows[1][f"arg{i}"] for i in range(4)] == list("abcd")
    assert rows[2].args is None and rows[2].arg0 is None


def test_decoders_over_two_tables(spark):
    """Both sides from one table, results pruned, and sequences that one side lacks."""
    rng = np.random.default_rng(5)
    rows = [(s, t, rng.normal(size=3).tolist()) for s in (1, 2, 3) for t in range(5)]
    x = spark.createDataFrame(rows, "seq_id long, t int, score array<double>")
    edges = x.filter("seq_id <> 3").select("seq_id", "t", (F.col("t") % 3).alias("src"), ((F.col("t") + 1) % 3).alias("dst"), F.lit(2.0).alias("s"))
    extra = edges.unionByName(edges.withColumn("seq_id", F.lit(9).cast("long")))
    moves = np.log(np.full((3, 3), 1 / 3))
    out = decode.viterbi_with_edges(x, extra, moves)
    assert out.count() == 15 and out.select("pred").count() == 15
    for s in (1, 2, 3):
        score = np.array([v for q, _, v in rows if q == s])
        gain = lambda p: sum(score[t][p[t]] + moves[p[t - 1]][p[t]] + (2.0 if s != 3 and (p[t - 1], p[t]) == (t % 3, (t + 1) % 3) else 0) for t in range(1, 5))  # noqa: B023, E731
        best = max(((0, *p) for p in itertools.product(range(3), repeat=4)), key=gain)
        assert [r.pred for r in out.filter(f"seq_id = {s}").orderBy("t").collect()] == list(best)
    places = spark.createDataFrame([(1, 1), (1, 5), (1, 9), (2, 4), (3, 2), (3, 7)], "seq_id long, t int")
    got = decode.match_keyframes(places.filter("t <> 4"), places.filter("t < 7 and seq_id < 3"))
    assert got.count() == 3 and got.select("cost").count() == 3
    assert {(r.seq_id, r.matched, r.cost, r.false_alarms, r.misses) for r in got.collect()} == {(1, 2, 0.0, 1, 0), (2, 0, 0.0, 0, 1), (3, 0, 0.0, 2, 0)}
    a, b = [1, 4, 8, 9, 20], [2, 9, 10]
    both = spark.createDataFrame([(1, t, 0) for t in a] + [(1, t, 1) for t in b], "seq_id long, t int, side int")
    cost = decode.match_keyframes(both.filter("side = 0"), both.filter("side = 1")).first().cost
    assert cost == min(sum(abs(i - j) for i, j in zip(p, b)) for p in itertools.permutations(a, len(b)))


def test_states_of_repeated_and_undone_actions(spark):
    rng = np.random.default_rng(8)
    rows = [(s, 10 * i, int(rng.integers(-1, 2)), int(rng.integers(0, 3))) for s in (1, 2) for i in range(40)]
    got = {(r.seq_id, r.step): r.state for r in states.assembly_states(spark.createDataFrame(rows, "seq_id long, step int, op int, part int")).collect()}
    now = {1: set(), 2: set()}
    for s, step, op, part in rows:
        now[s] = now[s] | {part} if op == 1 else now[s] - {part} if op == -1 else now[s]
        assert got[s, step] == sorted(now[s])


def test_edit_score_with_many_classes(spark):
    rows = [(1, t, t, t if t % 2 else t + 256) for t in range(600)]
    out = metrics.edit_score(spark.createDataFrame(rows, "seq_id long, t int, truth int, pred int")).first()
    assert math.isclose(out.edit, 0.5)


def test_map_sequences(spark):
    a = spark.createDataFrame([(1, 0, 2.0), (1, 1, 3.0), (2, 0, 5.0)], "seq_id long, t int, v double")
    b = spark.createDataFrame([(1, "x"), (3, "y")], "seq_id long, name string")

    def f(x, y):
        who = (x if len(x) else y)["seq_id"].iloc[0]
        return pd.DataFrame({"seq_id": [who], "total": [float(x["v"].sum())], "last": [int(x["t"].max()) if len(x) else -1], "names": ["".join(y["name"])]})

    out = decode.map_sequences(f, "seq_id long, total double, last long, names string", a, b)
    assert {tuple(r) for r in out.collect()} == {(1, 5.0, 1, "x"), (2, 5.0, 0, ""), (3, 0.0, -1, "y")} and out.count() == 3


def test_overlap_across_stretches(spark):
    rows = [(1, t, t // 700, (t + 100) // 700) for t in range(2100)]
    got = metrics.overlap_score(spark.createDataFrame(rows, "seq_id long, t int, truth int, pred int")).first().overlap
    want = [(600 / 700), (600 / 800), (600 / 800)]  # 0: 600 of 700; 1 and 2: shifted by 100
    assert math.isclose(got, sum(want) / 3, abs_tol=5e-7) and math.isclose(metrics.overlap_score(spark.createDataFrame(rows, "seq_id long, t int, truth int, pred int"), width=7).first().overlap, got)


def test_components_of_a_long_chain_and_of_many_graphs(spark):
    import random

    from seqloom.functions.graphs import components

    rng = random.Random(5)
    names = list(range(10_000))
    rng.shuffle(names)
    chain = [(0, a, b) for a, b in zip(names, names[1:], strict=False)]
    small = [(1 + i % 300, rng.randrange(12), rng.randrange(12)) for i in range(2000)]
    edges = spark.createDataFrame([*chain, *small, *small[:50], (7, None, 3), (400, 5, 5)], "g int, a int, b int")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for g, a, b in [*small, (400, 5, 5)]:
        low, high = sorted((find((g, a)), find((g, b))))
        root[high] = low
    got = {(r.g, r.v): r.l for r in components(edges, "g", most_rounds=20).collect()}
    assert {v: found for (g, v), found in got.items() if g == 0} == dict.fromkeys(range(10_000), 0)
    assert {k: found for k, found in got.items() if k[0]} == {k: find(k)[1] for k in root}
    assert components(edges.limit(0), "g").count() == 0


def test_branch_states_with_gaps_and_alternatives(spark):
    from seqloom.operators.states import branch_states

    acts = [(1, 0, 0, 1), (1, 1, 0, 1), (1, 3, 0, -1), (2, 1, 0, 1), (3, 0, 0, 1), (3, 0, 1, 1), (3, 1, 0, -1), (4, 0, 9, 0), (4, 1, 9, 1), (4, 2, 0, 1), (5, 0, None, 1)]
    actions = spark.createDataFrame(acts, "seq_id long, step int, cls int, op int")
    classes = spark.createDataFrame([(0, 1), (0, 2), (1, 5), (1, None)], "cls int, part int")
    got = sorted((r.seq_id, r.step, tuple(r.state)) for r in branch_states(actions, classes).collect())
    assert got == [(1, 0, (1,)), (1, 0, (2,)), (1, 1, (1, 2)), (3, 0, (1,)), (3, 0, (2,)), (3, 0, (5,)), (3, 1, ()), (4, 0, ())]
    assert {r.step for r in branch_states(actions, classes, 1).collect()} == {0}
    long = spark.createDataFrame([(9, k, 0, 1 if k % 2 == 0 else -1) for k in range(3000)], "seq_id long, step int, cls int, op int")
    assert branch_states(long, classes).count() == 3000 // 2 * 3


def test_frame_scores_equal_brute_force(spark):
    import math
    import random

    from seqloom.operators.relations import FrameScores

    rng = random.Random(2)
    pairs = [(a, b) for a in range(5) for b in range(a + 1, 5)]
    states = {k: sorted(rng.sample(pairs, rng.randrange(0, 6))) for k in range(3, 40)}
    rows = [(s, t, *rng.choice([(a, b), (b, a)]), rng.choice([None, -2, -1, 0, 1, 3])) for s in range(3) for t in range(7) for a, b in rng.sample(pairs, 6)]
    rows += [(0, 0, 1, 2, 4), (0, 1, 0, 77, 2), (0, 2, 3, 3, 1), (0, 3, None, 2, 9), (5, 0, 0, 1, None)]
    features = spark.createDataFrame(rows, "seq_id int, t int, a int, b int, value int")
    table = spark.createDataFrame([(k, [{"a": b if k % 2 else a, "b": a if k % 2 else b} for a, b in v]) for k, v in states.items()], "state_id int, pairs array<struct<a:int,b:int>>")
    frames = {}
    for s, t, a, b, v in rows:
        f = frames.setdefault((s, t), {})
        if None not in (a, b, v):
            f[min(a, b), max(a, b)] = f.get((min(a, b), max(a, b)), 0) + v
    for block in (1, 5, 1024):
        x = FrameScores(features, table, scale=0.5, block=block, slices=3)
        found, best = {(r.seq_id, r.t, r.state_id): r for r in x.all().collect()}, {(r.seq_id, r.t): r for r in x.best().collect()}
        assert len(found) == len(frames) * len(states) and best.keys() == frames.keys()
        for at, f in frames.items():
            s = {k: 0.5 * sum(v if p in pairs_ else -v for p, v in f.items()) for k, pairs_ in states.items()}
            norm = math.log(sum(map(math.exp, s.values())))
            assert all(found[*at, k].s == v and abs(found[*at, k].log_prob - v + norm) < 1e-9 for k, v in s.items())
            assert best[at].state_id == min(s, key=lambda k: (-s[k], k)) and best[at].s == max(s.values()) and abs(best[at].log_prob - max(s.values()) + norm) < 1e-9
    assert FrameScores(features.limit(0), table).all().count() == 0
    assert FrameScores(features, table.limit(0)).all().count() == FrameScores(features, table.limit(0)).best().count() == 0


def _exploded(spark):
    """Five sequences of 300 frames each, whose table Spark estimates at the size of five rows."""
    ends = spark.range(5).groupBy(F.col("id").alias("seq_id")).agg((F.max("id") * 0 + 299).cast("int").alias("n"))
    return ends.select("seq_id", F.explode(F.sequence(F.lit(0), "n")).alias("t"))


def _broadcasts_frames(df):
    """The plan that ran has the explode of the frames below a broadcast."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i in (i for i, x in enumerate(lines) if "BroadcastExchange" in x):
        below = itertools.takewhile(lambda j: depth[j] > depth[i], range(i + 1, len(lines)))
        if any("Generate explode(sequence" in lines[j] for j in below):
            return True
    return False


def test_exploded_frames_are_not_broadcast_for_phases(spark):
    actions = spark.createDataFrame([(0, 1, 10, 20, 1), (0, 2, 30, 40, 7), (1, 3, 5, 6, 0), (2, 4, 0, 1, 8)], "seq_id long, ann_id long, start int, end int, action int")
    out = labels.activity_phase(_exploded(spark), actions)
    got = {(r.seq_id, r.t): r.phase for r in out.collect()}
    assert got == {(s, t): 0 if t < a else 2 if t > b else 1 for s, a, b in ((0, 10, 40), (1, 5, 6)) for t in range(300)}
    assert not _broadcasts_frames(out)


def test_exploded_frames_are_not_broadcast_for_items(spark):
    actions = spark.createDataFrame([(0, 1, 10, 1, 3, 4), (0, 2, 5, 1, 3, None), (0, 3, 2, 7, 4, 3), (1, 4, 7, 0, 5, 6)], "seq_id long, ann_id long, start int, action int, object int, target int")
    items = spark.createDataFrame([(0, 3), (0, 3), (0, 9), (1, 6), (1, None), (7, 1)], "seq_id long, item int")
    out = labels.until_first_touch(_exploded(spark), actions, items)
    rows = out.collect()
    got = {(r.seq_id, r.item, r.t): r.in_basket for r in rows}
    first = {(0, 3): 10, (0, 9): 300, (1, 6): 7, (1, None): 300}
    assert len(rows) == len(got) and got == {(s, i, t): int(t < f) for (s, i), f in first.items() for t in range(300)}
    assert not _broadcasts_frames(out)


def test_python_reductions_over_batches(spark):
    """Segments longer than an Arrow batch, many short ones, and callables that write into their values; no worker call a segment."""
    rows = [(s, t, 0 if t < 25_000 else t // 3, float((t * 7919) % 1009)) for s in (1, 2) for t in range(30_000)]
    df = spark.createDataFrame(rows, "seq_id long, t int, seg_id int, v double")

    def middle(v):
        v.sort()
        return v[len(v) // 2]

    out = segments.reduce_with(df, {"middle": (middle, ["v"]), "drift": (lambda v, w: v[-1] - w[0], ["v", "v"])}, F.count("*").alias("n"))
    got = {(r.seq_id, r.seg_id): (r.middle, r.drift, r.n) for r in out.collect()}
    want = {}
    for s, _, g, v in rows:
        want.setdefault((s, g), []).append(v)
    assert got == {k: (sorted(v)[len(v) // 2], v[-1] - v[0], len(v)) for k, v in want.items()}
    assert "Aggregate" not in segments.reduce_with(df, {"middle": (middle, ["v"])})._jdf.queryExecution().optimizedPlan().toString()


def test_signatures_of_small_and_large_states(spark, monkeypatch):
    """Small states are folded without rounds; large ones, which settle in rounds, have the same signatures and scores."""
    import random

    from seqloom.functions import graphs

    rng = random.Random(3)
    rows = [(s, rng.randrange(30), rng.randrange(30)) for s in range(40) for _ in range(rng.randrange(1, 20))] + [(0, 1, None), (None, 1, 2), (50, 4, 4)]
    joints = spark.createDataFrame(rows, "state_id long, a int, b int")
    features = spark.createDataFrame([(s, rng.randrange(30), rng.randrange(30), float(rng.randrange(100))) for s in range(42) for _ in range(60)], "state_id long, a int, b int, value double")
    label = {}
    for s, a, b in rows:
        if s is not None and b is not None:
            of = label.setdefault(s, {})
            x, y = of.setdefault(a, {a}), of.setdefault(b, {b})
            for v in x | y:
                of[v] = x | y
    want = {(s, a, b): 1 if b in of[a] else -1 for s, of in label.items() for a in of for b in of if a < b}
    limits, rounds = [], graphs.components_by_rounds
    few = graphs.grouped_components
    for most in (64, 5):
        for module in (states, relations):
            monkeypatch.setattr(module, "grouped_components", lambda e, *scope, n=most: few(e, *scope, few=n))
        monkeypatch.setattr(states, "components_by_rounds", lambda *x: limits.append(most) or rounds(*x))  # noqa: B023
        signatures = states.component_signature(joints)
        assert {(r.state_id, r.a, r.b): r.same for r in signatures.collect()} == want
        pairs = {(r.state_id): (r.s, r.log_prob) for r in relations.component_state_scores(signatures, features).collect()}
        joined = {(r.state_id): (r.s, r.log_prob) for r in relations.joint_state_scores(joints, features).collect()}
        assert pairs.keys() == joined.keys() and all(np.allclose(pairs[k], joined[k]) for k in pairs)
        assert set(limits) == (set() if most == 64 else {5})
    got = {(r.state_id, r.v): r.l for r in graphs.components(joints, "state_id", few=5).collect()}
    assert got == {(s, v): min(g) for s, of in label.items() for v, g in of.items()}
