"""Decoders in blocks and under durations: against whole-sequence decoding and enumeration, with sequences that can't be decoded."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqloom.operators import decode, metrics, segments

KIND = "seq_id long, t int, score array<double>"


def sequences(rng, lengths, k):
    return [(s, t, rng.normal(size=k).tolist()) for s, n in enumerate(lengths) for t in range(n)]


def by_seq(df, *columns):
    out = {}
    for r in df.orderBy("seq_id", "t").collect():
        out.setdefault(r.seq_id, []).append(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]])
    return out


@pytest.mark.parametrize("block", [1, 2, 3, 7, 16])
def test_blocks_give_what_whole_sequences_give(spark, block):
    rng = np.random.default_rng(block)
    k = 4
    rows = sequences(rng, [1, 2, 16, 33, 50], k)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    x = spark.createDataFrame(rows, KIND)
    moves = rng.normal(size=(k, k))
    moves[0, 3] = -np.inf
    score = {s: np.array([v for _, _, v in sorted(r for r in rows if r[0] == s)]) for s in range(5)}
    for start in (0, 2, None):
        got = by_seq(decode.viterbi(x, moves, start, block=block), "pred")
        assert got == {s: decode.best_path(v, moves, start).tolist() for s, v in score.items()}
    extra = [(s, t, int(rng.integers(k)), int(rng.integers(k)), float(rng.normal() * 3)) for s in range(5) for t in range(0, 50, 2)] + [(2, 4, 1, 1, 2.0)] * 2
    edges = spark.createDataFrame(extra, "seq_id long, t int, src int, dst int, s double")
    got = by_seq(decode.viterbi_with_edges(x, edges, moves, block=block), "pred")
    for s, v in score.items():
        assert got[s] == decode.best_path(v, moves, 0, None, [[e[2:] for e in extra if e[:2] == (s, t)] for t in range(len(v))]).tolist()
    got = by_seq(decode.marginals(x, moves, block=block), "pred", "log_prob")
    for s, v in score.items():
        p = decode.posterior(v, moves)
        assert [a for a, _ in got[s]] == p.argmax(axis=1).tolist() and np.allclose([b for _, b in got[s]], p.max(axis=1))
    for beam in (-0.5, -3.0):
        want = {}
        for s, v in score.items():
            try:
                want[s] = decode.best_path(v, moves, 0, beam).tolist()
            except decode.Unsolved:
                want[s] = [None] * len(v)
        assert by_seq(decode.viterbi(x, moves, 0, beam, block=block), "pred") == want


def test_a_million_frames(spark):
    n, k = 1_000_000, 2
    wave = F.sin(F.col("t") / 5000.0) * 3
    x = spark.range(n).select(F.lit(7).cast("long").alias("seq_id"), F.col("id").cast("int").alias("t")).withColumn("score", F.array(wave, -wave))
    moves = np.log(np.array([[0.99, 0.01], [0.01, 0.99]]))
    out = decode.viterbi(x, moves)
    off = out.join(x, ["seq_id", "t"]).filter("abs(score[0]) > 0.2 and pred <> (case when score[0] > 0 then 0 else 1 end) or reason is not null")
    assert out.count() == n and off.count() <= 2 * k


@pytest.mark.parametrize("block", [3, 1000])
def test_sequences_that_cannot_be_decoded(spark, block):
    nan = float("nan")
    rows = [(1, t, [0.0, 1.0]) for t in range(8)] + [(2, t, None if t == 4 else [0.0, 1.0]) for t in range(8)] + [(3, t, [0.0, nan if t == 6 else 1.0]) for t in range(8)]
    rows += [(4, t, [0.0] * (1 + t // 4)) for t in range(8)] + [(5, t, [-math.inf, -math.inf] if t == 5 else [0.0, 1.0]) for t in range(8)] + [(6, t, []) for t in range(8)]
    x = spark.createDataFrame(rows, KIND)
    moves = np.log(np.full((2, 2), 0.5))
    want = {1: None, 2: "bad score", 3: "bad score", 4: "bad score", 5: "no path", 6: "bad score"}
    durations = np.log(np.full((2, 3), 1 / 3))
    found = [
        decode.viterbi(x, moves, block=block), decode.viterbi(x, moves, beam=-2.0, block=block), decode.marginals(x, moves, block=block),
        decode.duration_decode(x, durations, moves, np.zeros(2)), decode.duration_decode(x, durations, moves, np.zeros(2), marginal=True),
    ]
    for df in found:
        rows = df.collect()
        assert len(rows) == 48
        assert {(r.seq_id, r.reason, r.pred is None) for r in rows} == {(s, why, why is not None) for s, why in want.items()}
    assert decode.viterbi(x.limit(0), moves).count() == 0


def segmentations(n, k, longest):
    """All ways to cut n frames into segments (state, length)."""
    if n == 0:
        yield ()
    for d in range(1, min(n, longest) + 1):
        for j in range(k):
            for rest in segmentations(n - d, k, longest):
                yield ((j, d), *rest)


@pytest.mark.parametrize("self_moves", [False, True])
def test_duration_posterior_against_enumeration(self_moves):
    rng = np.random.default_rng(3)
    n, k, longest = 5, 3, 3
    for _ in range(4):
        s, durations, moves, starts = rng.normal(size=(n, k)), rng.normal(size=(k, longest)), rng.normal(size=(k, k)), rng.normal(size=k)
        if not self_moves:
            moves = np.where(np.eye(k) > 0, -np.inf, moves)
        want, total, best = np.zeros((n, k)), 0.0, (-np.inf, [])
        for way in segmentations(n, k, longest):
            labels = [j for j, d in way for _ in range(d)]
            value = starts[way[0][0]] + sum(s[t, j] for t, j in enumerate(labels)) + sum(durations[j, d - 1] for j, d in way) + sum(moves[a[0], b[0]] for a, b in zip(way, way[1:]))
            weight = math.exp(value)
            best = max(best, (value, labels))
            total += weight
            for t, j in enumerate(labels):
                want[t, j] += weight
        assert np.allclose(decode.duration_posterior(s, durations, moves, starts), want / total)
        assert decode.best_durations(s, durations, moves, starts).tolist() == best[1]


@pytest.mark.parametrize("marginal", [False, True])
def test_joint_decode_against_enumeration(spark, marginal):
    rng = np.random.default_rng(8)
    n, events, states, longest = 4, 3, 2, 2
    scores, durations, starts = rng.normal(size=(n, events)), rng.normal(size=(events, longest)), np.array([0.3, -0.2])
    table = rng.normal(size=(events, states, states))
    table[0, 0, 1] = table[1, :, 0] = -np.inf
    share_e, share_s, pair, best = np.zeros((n, events)), np.zeros((n, states)), np.zeros((n, events, states)), (-np.inf, [])
    for way in segmentations(n, events, longest):
        for path in itertools.product(range(states), repeat=len(way) + 1):
            value = starts[path[0]] + sum(durations[e, d - 1] for e, d in way) + sum(table[e, path[i], path[i + 1]] for i, (e, _) in enumerate(way))
            labels = [(e, path[i + 1]) for i, (e, d) in enumerate(way) for _ in range(d)]
            value += sum(scores[t, e] for t, (e, _) in enumerate(labels))
            best = max(best, (value, labels))
            for t, (e, q) in enumerate(labels):
                for into, key in ((share_e, (t, e)), (share_s, (t, q)), (pair, (t, e, q))):
                    into[key] += math.exp(value)
    x = spark.createDataFrame([(1, t, v.tolist()) for t, v in enumerate(scores)], KIND)
    got = by_seq(decode.joint_decode(x, durations, table, starts, marginal), "event", "state")[1]
    if not marginal:
        assert got == best[1]
        return
    assert got == [tuple(int(i) for i in np.unravel_index(pair[t].argmax(), (events, states))) for t in range(n)]
    each = by_seq(decode.joint_decode(x, durations, table, starts, True, "each"), "event", "state")[1]
    assert each == list(zip(share_e.argmax(axis=1).tolist(), share_s.argmax(axis=1).tolist()))


def test_joint_segments_of_many_channels(spark):
    rows = pd.DataFrame({"seq_id": [1] * 6, "t": range(6)})
    for c in range(40):
        rows[f"c{c}"] = [int(t >= 3 and c == 39) for t in range(6)]
    df = spark.createDataFrame(rows)
    for least in (0, 2):
        assert [r.seg_id for r in segments.joint_segments(df, [f"c{c}" for c in range(40)], least).orderBy("t").collect()] == [0, 0, 0, 1, 1, 1]


def test_overlap_is_exact_in_any_order(spark):
    rows = [(1, t, t // 3, (t + 1) // 3) for t in range(900)]
    df = spark.createDataFrame(rows, "seq_id long, t int, truth int, pred int")
    assert {metrics.overlap_score(df.repartition(n)).first().overlap for n in (1, 3, 8)} == {0.500556}
