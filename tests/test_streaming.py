"""Streams of many batches: rows out of order, late ones, and state that is dropped."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import decode, states
from seqloom.streaming import online


@pytest.fixture
def arriving(spark, tmp_path):
    """A stream that reads one batch after the other from lists of rows."""
    made = []

    def of(batches, schema, delay):
        made.append(0)
        at = tmp_path / f"in{len(made)}"
        for i, rows in enumerate(batches):
            df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("at")).drop("at")
            df.coalesce(1).write.parquet(str(at / str(i)))
        return online.stream_session(spark, 2).readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/*").withWatermark("ts", delay)

    return of


@pytest.fixture
def finished(tmp_path):
    def run(out):
        q = out.writeStream.format("memory").queryName(f"q{id(out)}").outputMode("append").option("checkpointLocation", str(tmp_path / f"cp{id(out)}")).trigger(availableNow=True).start()
        q.awaitTermination(200)
        progress = q.recentProgress
        assert sum(p.numInputRows > 0 for p in progress) > 1
        late = sum(o.numRowsDroppedByWatermark for p in progress for o in p.stateOperators)
        return out.sparkSession.table(f"q{id(out)}").collect(), late, progress

    return run


ACT = "seq_id long, step int, part int, op int, at long"


def test_states_out_of_order(spark, arriving, finished):
    rng = np.random.default_rng(0)
    rows = [(s, t, int(rng.integers(4)), int(rng.integers(-1, 2)), 1000 + 60 * t) for s in range(5) for t in range(12)]
    batch = [min(9, r[1] // 2 + int(rng.integers(3))) for r in rows]  # up to two batches late
    batches = [[rows[i] for i in rng.permutation(len(rows)) if batch[i] == b] for b in range(10)]
    ends = [[(-1, k, 0, 0, 100_000 * (k + 1))] for k in range(3)]
    got, late, progress = finished(online.track_states(arriving([b for b in batches if b] + ends, ACT, "10 minutes")))
    got = [r for r in got if r.seq_id >= 0]
    want = states.assembly_states(spark.createDataFrame(rows, ACT)).collect()
    assert sorted((r.seq_id, r.step, list(r.state)) for r in got) == sorted((r.seq_id, r.step, list(r.state)) for r in want)
    assert late == 0
    held = [p.stateOperators[0].numRowsTotal for p in progress]
    assert max(held) >= 5 and held[-1] <= 1  # only the last row still waits


def test_four_files_in_the_wrong_order(spark, arriving, finished):
    acts = {2: (7, 1), 3: (7, -1), 0: (5, 1), 1: (6, 1)}
    batches = [[(1, t, *acts[t], 1000 + 60 * t)] for t in acts] + [[(-1, 0, 0, 0, 90_000)]]
    got, _, _ = finished(online.track_states(arriving(batches, ACT, "5 minutes")))
    assert {r.step: list(r.state) for r in got} == {0: [5], 1: [5, 6], 2: [5, 6, 7], 3: [5, 6]}


def test_late_rows_are_counted_and_initial_state_is_used(spark, arriving, finished):
    batches = [[(1, 0, 1, 1, 600)], [(1, 5, 2, 1, 6000)], [(1, 6, 4, 1, 6001)], [(1, 1, 3, 1, 700)], [(-1, 0, 0, 0, 90_000)]]
    initial = spark.createDataFrame([(1, [9]), (2, [8])], "seq_id long, parts array<int>")
    stream = arriving(batches, ACT, "10 minutes")
    before = stream.sparkSession.createDataFrame(initial.collect(), initial.schema)
    got, late, _ = finished(online.track_states(stream, "3 hours", before))
    assert {r.step: list(r.state) for r in got} == {0: [1, 9], 5: [1, 2, 9], 6: [1, 2, 4, 9]}
    assert late == 1


def test_state_is_dropped_after_the_timeout(spark, arriving, finished):
    batches = [[(1, 0, 1, 1, 600)], [(2, 0, 1, 1, 20_000)], [(2, 1, 2, 1, 20_100)], [(1, 9, 5, 1, 40_000)], [(-1, 0, 0, 0, 90_000)]]
    got, _, _ = finished(online.track_states(arriving(batches, ACT, "1 minute"), "1 hour"))
    assert {(r.seq_id, r.step): list(r.state) for r in got} == {(1, 0): [1], (2, 0): [1], (2, 1): [1, 2], (1, 9): [5]}


def test_forward_filter_out_of_order(spark, arriving, finished):
    rng = np.random.default_rng(1)
    k, n = 3, 8
    moves = np.log(np.full((k, k), 0.1) + 0.7 * np.eye(k))
    score = rng.normal(size=(n, k))
    order = [1, 0, 3, 2, 4, 7, 5, 6]
    batches = [[(4, t, score[t].tolist(), 1000 + 60 * t)] for t in order] + [[(-1, 0, [0.0] * k, 90_000)]]
    got, _, _ = finished(online.forward_filter(arriving(batches, "seq_id long, t int, score array<double>, at long", "5 minutes"), moves))
    got = {r.t: (r.state, r.log_prob) for r in got}
    for t in range(n):
        last = decode.posterior(score[: t + 1], moves)[-1]
        assert got[t][0] == last.argmax() and np.isclose(got[t][1], last.max())


EV = "seq_id long, label string, code int, score double, at long"


def test_windows_and_sessions_drop_late_rows(spark, arriving, finished):
    rows = [(1, "a", 0, 1.0, 100), (1, "b", 1, 5.0, 30), (1, "c", 0, 9.0, 450), (1, "d", 1, 2.0, 1000), (1, "late", 0, 99.0, 90)]
    between = (-1, "x", 0, 0.0, 1000)  # a row is late once a batch has run with a watermark past it
    batches = [rows[:2], rows[2:4], [between], rows[4:], [(-1, "end", 0, 0.0, 90_000)]]
    best, late, _ = finished(online.best_event_per_window(arriving(batches, EV, "1 minute"), "5 minutes"))
    assert {(r.win.start.timestamp(), r.label) for r in best} == {(0, "b"), (300, "c"), (900, "d")} and late == 1
    pairs, late, _ = finished(online.sliding_pair(arriving(batches, EV, "1 minute"), 0, 1, "10 minutes", "5 minutes"))
    want = {}
    for _, _, code, score, at in [*rows[:4], between]:
        for start in (at // 300 * 300, at // 300 * 300 - 300):
            want.setdefault(start, ([], []))[code].append(score)
    mean = lambda x: sum(x) / len(x) if x else None
    assert {(r.win.start.timestamp(), r.a, r.b, r.n) for r in pairs} == {(s, mean(a), mean(b), len(a) + len(b)) for s, (a, b) in want.items()} and late >= 1
    sessions, late, _ = finished(online.activity_sessions(arriving(batches, EV, "1 minute"), "5 minutes"))
    assert {(r.win.start.timestamp(), r.n) for r in sessions} == {(30, 2), (450, 1), (1000, 1)} and late == 1


def test_join_of_two_streams(spark, arriving, finished):
    left = [[(1, 1, 100)], [(1, 2, 1000)], [(1, 2, 1001)], [(1, 3, 110)], [(-1, 0, 90_000)]]  # 110 comes after both have passed it
    right = [[(1, 10, 130)], [(1, 11, 1050)], [(1, 12, 2000)], [(1, 13, 2001)], [(-2, 0, 90_000)]]
    a = arriving(left, "seq_id long, click int, at long", "2 minutes")
    other = arriving(right, "seq_id long, view int, at long", "2 minutes")
    got, late, _ = finished(online.bounded_join(a, other, "1 minute"))
    assert {(r.click, r.view) for r in got} == {(1, 10), (2, 11)}
    assert late == 1
    assert all(isinstance(r.ts_left, datetime.datetime) for r in got)


def test_many_sequences_share_state(spark, arriving, finished):
    """Python is called for a share of sequences at a time; a large id and rows without one keep their own order."""
    ids = [*range(1500), 2**60 + 1, None]
    batches = [[(s, t, t, 1, 1000 + 60 * t) for s in ids] for t in (1, 0)] + [[(-1, 0, 0, 0, 90_000)]]
    got, late, progress = finished(online.track_states(arriving(batches, ACT, "5 minutes")))
    assert sorted((r.seq_id is None, r.seq_id or 0, r.step, list(r.state)) for r in got) == sorted((s is None, s or 0, t, list(range(t + 1))) for s in ids for t in (0, 1))
    assert late == 0 and 1 < max(p.stateOperators[0].numRowsTotal for p in progress) <= 1025
