"""Sequence decoders: model tables small and sent along; all in log scores.

Scores come as (seq_id, t, score ARRAY<DOUBLE>); a model is a matrix over classes. Ties go to the
lowest class.

A sequence is decoded in one group while it fits ``BLOCK`` frames. Longer ones are cut into blocks
of that many steps of t, which need not lie in one worker: the best scores (or the sums of all) from
each class at a block's first frame to each at its last make up a k x k table, and such tables are
associative. Joined in order, one small row a block, they tell where the best path (or what weight)
enters and leaves each block, and then every block is traced on its own. Pruning to a beam looks at
all classes of a frame at once and has no such table, so long sequences with a beam are read as a
stream, in order, and their backpointers are kept in a scratch file of the task.

No sequence ends a job: one whose scores are null, not numbers or of different lengths, or that no
path fits, comes back whole with null classes and the reason in ``reason``.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.counts import transition_counts

PATH = "seq_id long, t int, pred int, reason string"
#: Frames (steps of t) of a block of a long sequence.
BLOCK = 20_000
NO_PATH, BAD_SCORE = "no path", "bad score"


class Unsolved(ValueError):
    """Why a sequence has no path."""


def log_matrix(frames: DataFrame, label: str, n: int, how: str = "counts", diagonal: float = 0.0) -> np.ndarray:
    """Log transition matrix of a class vocabulary: from counts, ``uniform``, or uniform on what was seen (``support``)."""
    if how == "uniform":
        return np.full((n, n), -np.log(n))
    m = np.zeros((n, n))
    for r in transition_counts(frames, label).select("src", "dst", "n").collect():  # at most n * n rows
        m[r["src"], r["dst"]] = 1.0 if how == "support" else r["n"]
    m += diagonal * np.eye(n)
    total = m.sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore"):
        return np.log(np.divide(m, total, out=np.zeros_like(m), where=total > 0))


def best_path(scores: np.ndarray, moves: np.ndarray, start: int | None = 0, beam: float | None = None, edges: np.ndarray | None = None) -> np.ndarray:
    """The best path. With a fixed start the first frame's scores are not used.

    ``beam`` (negative) drops classes that fall so far below a frame's best; ``edges[t]`` lists extra
    scores (src, dst, s) of the moves into frame t.
    """
    k = scores.shape[1]
    return _trace(scores, scores[0].copy() if start is None else np.where(np.arange(k) == start, 0.0, -np.inf), None, moves, beam, edges)


def _moved(moves: np.ndarray, edge: list | None) -> np.ndarray:
    """The moves into a frame with the extra scores of some of them."""
    if edge is None or not len(edge):
        return moves
    m = moves.copy()
    for e in edge:
        a, b, v = (e["src"], e["dst"], e["s"]) if isinstance(e, dict) else e
        m[a, b] += v
    return m


def _trace(scores: np.ndarray, first: np.ndarray, leave: int | None, moves: np.ndarray, beam: float | None = None, edges: list | None = None) -> np.ndarray:
    """The best path from ``first``, the scores at the first frame, to class ``leave`` at the last (None: the best)."""
    n, k = scores.shape
    now, came = first, np.zeros((n, k), np.int32)
    for t in range(1, n):
        if beam is not None:
            now = np.where(now >= now.max() + beam, now, -np.inf)
        reach = now[:, None] + (moves if edges is None else _moved(moves, edges[t]))
        came[t] = reach.argmax(axis=0)
        now = reach.max(axis=0) + scores[t]
    if not np.isfinite(now if leave is None else now[leave]).any():
        raise Unsolved(NO_PATH)
    path = np.empty(n, np.int64)
    path[-1] = now.argmax() if leave is None else leave
    for t in range(n - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def posterior(scores: np.ndarray, moves: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Log posterior of each class at each frame by the forward-backward recursions."""
    return _posterior(scores, scores[0] + (0 if start is None else start), np.zeros(scores.shape[1]), moves)


def _posterior(scores: np.ndarray, first: np.ndarray, last: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The same for a block: ``first`` is the weight of all before it and of its first frame, ``last`` of all that follows its last frame."""
    n, k = scores.shape
    ahead, back = np.empty((n, k)), np.empty((n, k))
    ahead[0], back[-1] = first, last
    for t in range(1, n):
        ahead[t] = _lse(ahead[t - 1][:, None] + moves, 0) + scores[t]
    for t in range(n - 2, -1, -1):
        back[t] = _lse(moves + (scores[t + 1] + back[t + 1])[None, :], 1)
    both = ahead + back
    total = _lse(both, 1)
    if not np.isfinite(total).all():
        raise Unsolved(NO_PATH)
    return both - total[:, None]


def best_segments(scores: np.ndarray, pairs: np.ndarray, most: int) -> np.ndarray:
    """The best labelling with at most ``most`` segments; ``pairs`` scores each change of class."""
    n, k = scores.shape
    change = pairs + np.where(np.eye(k) > 0, -np.inf, 0.0)
    now = np.full((most, k), -np.inf)
    now[0] = scores[0]
    came = np.zeros((n, most, k, 2), int)
    for t in range(1, n):
        stay = now
        enter = np.full((most, k), -np.inf)
        source = np.zeros((most, k), int)
        if most > 1:
            reach = now[:-1, :, None] + change[None]
            enter[1:], source[1:] = reach.max(axis=1), reach.argmax(axis=1)
        new = enter > stay
        came[t, :, :, 0] = np.where(new, np.arange(most)[:, None] - 1, np.arange(most)[:, None])
        came[t, :, :, 1] = np.where(new, source, np.arange(k)[None, :])
        now = np.where(new, enter, stay) + scores[t]
    s, c = np.unravel_index(int(now.argmax()), now.shape)
    path = [int(c)]
    for t in range(n - 1, 0, -1):
        s, c = came[t, s, c]
        path.append(int(c))
    return np.array(path[::-1])


def _spans(scores: np.ndarray, durations: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Of running sums: (d, k) scores of segments of d = 1, 2, ... frames that end before frame t, and the frames they begin at."""
    d = np.arange(1, min(durations.shape[1], t) + 1)
    return durations[:, : len(d)].T + scores[t] - scores[t - d], t - d


def best_durations(scores: np.ndarray, durations: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The best path when a state lasts d frames with log score durations[state, d - 1] and a move leads to the next.

    Where ``moves`` lets a state follow itself, a longer stay may be made of several.
    """
    n, k = scores.shape
    sums = np.concatenate([np.zeros((1, k)), np.cumsum(scores, axis=0)])
    entry, source, lasted = np.full((n + 1, k), -np.inf), np.zeros((n + 1, k), int), np.zeros((n + 1, k), int)
    entry[0] = starts
    for t in range(1, n + 1):
        span, at = _spans(sums, durations, t)
        reach = entry[at] + span
        lasted[t], best = reach.argmax(axis=0) + 1, reach.max(axis=0)
        reach = best[:, None] + moves
        entry[t], source[t] = reach.max(axis=0), reach.argmax(axis=0)
    if not np.isfinite(best).any():
        raise Unsolved(NO_PATH)
    t, j, runs = n, int(best.argmax()), []
    while t > 0:
        d = int(lasted[t, j])
        runs.append((j, d))
        t -= d
        j = int(source[t, j])
    return np.repeat(*zip(*runs[::-1], strict=True))


def duration_posterior(scores: np.ndarray, durations: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Posterior of each state at each frame over all segmentations, weighted as ``best_durations`` weighs one.

    Forward-backward over (state, duration): sums of all ways to end a segment at each frame and of all that follow from there give
    every segment's probability, and a frame has those of the segments around it.
    """
    n, k = scores.shape
    longest = durations.shape[1]
    sums = np.concatenate([np.zeros((1, k)), np.cumsum(scores, axis=0)])
    entry, ends = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
    entry[0] = starts
    for t in range(1, n + 1):
        span, at = _spans(sums, durations, t)
        ends[t] = _lse(entry[at] + span, 0)
        entry[t] = _lse(ends[t][:, None] + moves, 0)
    total = _lse(ends[n], 0)
    if not np.isfinite(total):
        raise Unsolved(NO_PATH)
    follow = np.full((n + 1, k), -np.inf)  # all that comes after a segment that ends before frame t
    follow[n] = 0
    for t in range(n - 1, 0, -1):
        d = np.arange(1, min(longest, n - t) + 1)
        begin = _lse(durations[:, : len(d)].T + sums[t + d] - sums[t] + follow[t + d], 0)
        follow[t] = _lse(moves + begin[None, :], 1)
    change = np.zeros((n + 1, k))
    for d in range(1, min(longest, n) + 1):
        weight = np.exp(entry[: n - d + 1] + durations[:, d - 1] + sums[d:] - sums[: n - d + 1] + follow[d:] - total)
        change[: n - d + 1] += weight
        change[d:] -= weight
    return np.clip(np.cumsum(change[:n], axis=0), 0.0, 1.0)


def _fresh(df: DataFrame, *columns: str) -> DataFrame:
    """These columns under new identities: if both sides of a cogroup come from one table, the function's columns are else taken for the other side's and pruned."""
    return df.select(*[F.col(c).alias(c) for c in columns])


def _matrix(rows: pd.Series) -> np.ndarray:
    """The scores of some frames; complains about a null, a NaN or a length of its own."""
    if rows.isna().any() or len({len(x) for x in rows}) > 1 or not len(rows.iloc[0]):
        raise Unsolved(BAD_SCORE)
    x = np.stack(rows.to_numpy()).astype(float)
    if np.isnan(x).any():
        raise Unsolved(BAD_SCORE)
    return x


def _solved(pdf: pd.DataFrame, schema: str, solve: Callable[[pd.DataFrame], dict]) -> pd.DataFrame:
    """Sequence, time and what ``solve`` finds for them; nulls and a reason where it can't."""
    out = {"seq_id": pdf["seq_id"], "t": pdf["t"]}
    try:
        found = solve(pdf) | {"reason": None}
    except Unsolved as e:
        found = {"reason": str(e)}
    kinds = dict(x.split() for x in schema.split(", "))
    nothing = {c: pd.array([None] * len(pdf), {"int": "Int32", "double": "Float64", "string": "string"}[kinds[c]]) for c in kinds if c not in out}
    return pd.DataFrame(out | {c: x if found.get(c) is None else found[c] for c, x in nothing.items()})


def _grouped(scores: DataFrame, solve: Callable[[np.ndarray], dict], schema: str = PATH) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _solved(pdf.sort_values("t"), schema, lambda x: solve(_matrix(x["score"])))

    return scores.select("seq_id", F.col("t").cast("int").alias("t"), "score").groupBy("seq_id").applyInPandas(run, schema)


def _parted(frames: DataFrame, block: int) -> tuple[DataFrame, DataFrame | None]:
    """Frames of sequences that lie in one block, and those of longer ones with the number of their block (None if there are none)."""
    at = F.floor(F.col("t") / block)
    long = frames.groupBy("seq_id").agg(F.min(at).alias("_a"), F.max(at).alias("_b")).filter("_a < _b").select("seq_id")
    if long.isEmpty():
        return frames, None
    return frames.join(long, "seq_id", "left_anti"), frames.join(long, "seq_id", "left_semi").withColumn("_block", at)


def _best_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def _sum_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _lse(a[:, :, None] + b[None, :, :], 1)


def _tables(frames: DataFrame, moves: np.ndarray, then: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(seq_id, _block, table, first, into): from each class at a block's first frame to each at its last, the first frame's scores and the moves into it; nulls for a bad block."""
    k = len(moves)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        row = {"seq_id": pdf["seq_id"].iloc[:1], "_block": pdf["_block"].iloc[:1]}
        try:
            x = _matrix(pdf["score"])
            if x.shape[1] != k:
                raise Unsolved(BAD_SCORE)
        except Unsolved:
            return pd.DataFrame(row | {"table": [None], "first": [None], "into": [None]})
        edges = pdf["edges"].to_list()
        m = np.where(np.eye(k) > 0, 0.0, -np.inf)
        for t in range(1, len(x)):
            m = then(m, _moved(moves, edges[t]) + x[t][None, :])
        return pd.DataFrame(row | {"table": [m.ravel()], "first": [x[0]], "into": [_moved(moves, edges[0]).ravel()]})

    return frames.groupBy("seq_id", "_block").applyInPandas(run, "seq_id long, _block long, table array<double>, first array<double>, into array<double>")


def _entries(tables: DataFrame, k: int, start: int | None) -> DataFrame:
    """(seq_id, _block, enter, leave, reason): the classes in which the best path enters and leaves each block; one row a block and sequence is read."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        out = {"seq_id": pdf["seq_id"], "_block": pdf["_block"]}
        none = pd.array([None] * len(pdf), "Int32")
        if pdf["table"].isna().any():
            return pd.DataFrame(out | {"enter": none, "leave": none, "reason": BAD_SCORE})
        table, into = (np.stack(pdf[c].to_numpy()).reshape(-1, k, k) for c in ("table", "into"))
        first = np.stack(pdf["first"].to_numpy())
        at_first, at_last = [first[0] if start is None else np.where(np.arange(k) == start, 0.0, -np.inf)], []
        for b in range(len(pdf)):
            if b:
                at_first.append((at_last[-1][:, None] + into[b]).max(axis=0) + first[b])
            at_last.append((at_first[b][:, None] + table[b]).max(axis=0))
        if not np.isfinite(at_last[-1]).any():
            return pd.DataFrame(out | {"enter": none, "leave": none, "reason": NO_PATH})
        enter, leave = [], [int(at_last[-1].argmax())]
        for b in range(len(pdf) - 1, -1, -1):
            enter.append(int((at_first[b] + table[b][:, leave[-1]]).argmax()))
            if b:
                leave.append(int((at_last[b - 1] + into[b][:, enter[-1]]).argmax()))
        return pd.DataFrame(out | {"enter": enter[::-1], "leave": leave[::-1], "reason": None})

    return tables.groupBy("seq_id").applyInPandas(run, "seq_id long, _block long, enter int, leave int, reason string")


def _weights(tables: DataFrame, k: int) -> DataFrame:
    """(seq_id, _block, ahead, behind, reason): log weights of all before each block with its first frame, and of all after it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        out = {"seq_id": pdf["seq_id"], "_block": pdf["_block"]}
        if pdf["table"].isna().any():
            return pd.DataFrame(out | {"ahead": None, "behind": None, "reason": BAD_SCORE})
        table, into = (np.stack(pdf[c].to_numpy()).reshape(-1, k, k) for c in ("table", "into"))
        first = np.stack(pdf["first"].to_numpy())
        ahead, behind = [first[0]], [np.zeros(k)]
        for b in range(1, len(pdf)):
            ahead.append(_lse(_lse(ahead[-1][:, None] + table[b - 1], 0)[:, None] + into[b], 0) + first[b])
        for b in range(len(pdf) - 1, 0, -1):
            behind.append(_lse(into[b] + (first[b] + _lse(table[b] + behind[-1][None, :], 1))[None, :], 1))
        return pd.DataFrame(out | {"ahead": ahead, "behind": behind[::-1], "reason": None})

    return tables.groupBy("seq_id").applyInPandas(run, "seq_id long, _block long, ahead array<double>, behind array<double>, reason string")


def _streamed_beam(frames: DataFrame, moves: np.ndarray, start: int | None, beam: float) -> DataFrame:
    """Beam decoding of long sequences, read in order; only backpointers are kept, in a scratch file."""
    k = len(moves)
    kind = np.dtype([("t", "<i8"), ("came", "<u2", (k,))])

    def solved(seq: int, now: np.ndarray | None, reason: str | None, file, n: int) -> Iterator[pd.DataFrame]:
        if reason is None and not np.isfinite(now).any():
            reason = NO_PATH
        at = None if reason else int(now.argmax())
        for end in range(n, 0, -BLOCK):  # backwards in stretches
            begin = max(0, end - BLOCK)
            file.seek(begin * kind.itemsize)
            steps = np.frombuffer(file.read((end - begin) * kind.itemsize), kind)
            pred = pd.array([None] * len(steps), "Int32")
            if reason is None:
                path = np.empty(len(steps), np.int32)
                for i in range(len(steps) - 1, -1, -1):
                    path[i] = at
                    at = int(steps["came"][i, at])
                pred = path
            yield pd.DataFrame({"seq_id": seq, "t": steps["t"].astype(np.int32), "pred": pred, "reason": reason})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq, now, reason, file, n = None, None, None, None, 0
        for pdf in batches:
            for s, t, score in zip(pdf["seq_id"], pdf["t"], pdf["score"], strict=True):
                if file is None or s != seq:
                    if file is not None:
                        yield from solved(seq, now, reason, file, n)
                        file.close()
                    seq, now, reason, file, n = s, None, None, tempfile.TemporaryFile(), 0
                row = np.zeros(1, kind)
                row["t"] = t
                try:
                    x = _matrix(pd.Series([score]))[0]
                    if len(x) != k:
                        raise Unsolved(BAD_SCORE)
                except Unsolved as e:
                    reason, x = str(e), np.zeros(k)
                if now is None:
                    now = x if start is None else np.where(np.arange(k) == start, 0.0, -np.inf)
                else:
                    reach = np.where(now >= now.max() + beam, now, -np.inf)[:, None] + moves
                    row["came"][0] = reach.argmax(axis=0)
                    now = reach.max(axis=0) + x
                file.write(row.tobytes())
                n += 1
        if file is not None:
            yield from solved(seq, now, reason, file, n)
            file.close()

    return frames.select("seq_id", "t", "score").repartition("seq_id").sortWithinPartitions("seq_id", "t").mapInPandas(run, PATH)


def map_sequences(f, schema: str, *tables: DataFrame) -> DataFrame:
    """``f`` of the rows of each sequence, one pandas frame for each of ``tables`` (an empty one where a table lacks the sequence); rows in ``schema``.

    The tables meet in one shuffle by seq_id; a sequence is the unit of work.
    """
    tagged = None
    for k, table in enumerate(tables):
        one = table.select("seq_id", F.lit(k).alias("_table"), *[F.col(c).alias(f"_{k}_{c}") for c in table.columns if c != "seq_id"])
        tagged = one if tagged is None else tagged.unionByName(one, allowMissingColumns=True)
    names = [table.columns for table in tables]

    def run(rows: pa.Table) -> pa.Table:
        parts = []
        for k, columns in enumerate(names):
            own = rows.filter(pc.equal(rows["_table"], k))
            parts.append(pa.table({c: own["seq_id" if c == "seq_id" else f"_{k}_{c}"] for c in columns}).to_pandas())
        return pa.Table.from_pandas(f(*parts), preserve_index=False)

    return tagged.groupBy("seq_id").applyInArrow(run, schema)


def viterbi(scores: DataFrame, moves: np.ndarray, start: int | None = 0, beam: float | None = None, edges: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(seq_id, t, pred, reason): the most likely path of each sequence. ``edges`` has extra scores (seq_id, t, src, dst, s) of single moves into frames."""
    if beam is not None and edges is not None:
        raise ValueError("a beam with scores of single moves is not supported")
    frames = scores.select("seq_id", F.col("t").cast("int").alias("t"), "score")
    if edges is None:
        frames = frames.withColumn("edges", F.lit(None).cast("array<struct<src:int,dst:int,s:double>>"))
    else:
        extra = edges.groupBy("seq_id", F.col("t").cast("int").alias("t")).agg(F.collect_list(F.struct(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), F.col("s").cast("double").alias("s"))).alias("edges"))
        frames = frames.join(extra, ["seq_id", "t"], "left")
    short, long = _parted(frames, block)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return _solved(pdf.sort_values("t"), PATH, lambda x: {"pred": best_path(_matrix(x["score"]), moves, start, beam, x["edges"].to_list())})

    out = short.groupBy("seq_id").applyInPandas(whole, PATH)
    if long is None:
        return out
    if beam is not None:
        return out.unionByName(_streamed_beam(long, moves, start, beam))
    k = len(moves)

    def traced(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")

        def solve(x: pd.DataFrame) -> dict:
            if x["reason"].iloc[0] is not None:
                raise Unsolved(x["reason"].iloc[0])
            first = np.where(np.arange(k) == x["enter"].iloc[0], 0.0, -np.inf)
            return {"pred": _trace(_matrix(x["score"]), first, int(x["leave"].iloc[0]), moves, None, x["edges"].to_list())}

        return _solved(pdf, PATH, solve)

    at = _entries(_tables(long, moves, _best_of), k, start)
    return out.unionByName(_fresh(long, "seq_id", "_block", "t", "score", "edges").join(at, ["seq_id", "_block"]).groupBy("seq_id", "_block").applyInPandas(traced, PATH))


def viterbi_with_edges(scores: DataFrame, edges: DataFrame, moves: np.ndarray, block: int = BLOCK) -> DataFrame:
    """The same with extra scores (seq_id, t, src, dst, s) of single moves."""
    return viterbi(scores, moves, 0, None, edges, block)


MARGINAL = PATH + ", log_prob double"


def marginals(scores: DataFrame, moves: np.ndarray, block: int = BLOCK) -> DataFrame:
    """(seq_id, t, pred, reason, log_prob): the most likely class of each frame and its log posterior."""

    def likeliest(p: np.ndarray) -> dict:
        return {"pred": p.argmax(axis=1), "log_prob": p.max(axis=1)}

    frames = scores.select("seq_id", F.col("t").cast("int").alias("t"), "score")
    short, long = _parted(frames, block)
    out = _grouped(short, lambda s: likeliest(posterior(s, moves)), MARGINAL)
    if long is None:
        return out

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        def solve(x: pd.DataFrame) -> dict:
            if x["reason"].iloc[0] is not None:
                raise Unsolved(x["reason"].iloc[0])
            return likeliest(_posterior(_matrix(x["score"]), x["ahead"].iloc[0], x["behind"].iloc[0], moves))

        return _solved(pdf.sort_values("t"), MARGINAL, solve)

    at = _weights(_tables(long.withColumn("edges", F.lit(None)), moves, _sum_of), len(moves))
    return out.unionByName(_fresh(long, "seq_id", "_block", "t", "score").join(at, ["seq_id", "_block"]).groupBy("seq_id", "_block").applyInPandas(inside, MARGINAL))


def segmental_decode(scores: DataFrame, pairs: np.ndarray, most: int) -> DataFrame:
    """(seq_id, t, pred, reason) with at most ``most`` segments a sequence."""
    return _grouped(scores, lambda s: {"pred": best_segments(s, pairs, most)})


def duration_decode(scores: DataFrame, durations: np.ndarray, moves: np.ndarray, starts: np.ndarray, marginal: bool = False) -> DataFrame:
    """(seq_id, t, pred, reason) under explicit durations; with ``marginal`` the likeliest state of each frame, and its log_prob, instead of the best path."""
    if not marginal:
        return _grouped(scores, lambda s: {"pred": best_durations(s, durations, moves, starts)})

    def solve(s: np.ndarray) -> dict:
        p = duration_posterior(s, durations, moves, starts)
        return {"pred": p.argmax(axis=1), "log_prob": np.log(p.max(axis=1))}

    return _grouped(scores, solve, MARGINAL)


def joint_decode(events: DataFrame, durations: np.ndarray, event_state: np.ndarray, starts: np.ndarray, marginal: bool = False, of: str = "pair") -> DataFrame:
    """(seq_id, t, event, state, reason): events decoded together with the states they lead to.

    ``event_state[event, src, dst]`` is the log score of an event that turns state src into dst.
    Only allowed (event, dst) pairs become states of the dynamic programme; a pair lasts as long as
    its event does. ``marginal`` picks what is likeliest at each frame, under the same durations,
    instead of the best path: the ``pair``, or ``each`` of event and state by its own sums over pairs.
    """
    e, s, _ = event_state.shape
    pairs = [(i, j) for i in range(e) for j in range(s) if np.isfinite(event_state[i, :, j]).any()]
    moves = np.array([[event_state[i2, j, j2] for (i2, j2) in pairs] for (_, j) in pairs])
    gather = _lse(starts[None, :, None] + event_state, 1) if marginal else (starts[None, :, None] + event_state).max(axis=1)
    first = np.array([gather[i, j] for i, j in pairs])
    lasts = np.array([durations[i] for i, _ in pairs])
    which = np.array(pairs)

    def solve(x: np.ndarray) -> dict:
        wide = x[:, which[:, 0]]
        if not marginal:
            path = best_durations(wide, lasts, moves, first)
            return {"event": which[path, 0], "state": which[path, 1]}
        p = duration_posterior(wide, lasts, moves, first)
        if of == "pair":
            path = p.argmax(axis=1)
            return {"event": which[path, 0], "state": which[path, 1]}
        one = lambda c, m: (p @ (which[:, c][:, None] == np.arange(m))).argmax(axis=1)
        return {"event": one(0, e), "state": one(1, s)}

    return _grouped(events, solve, "seq_id long, t int, event int, state int, reason string")


def match_keyframes(pred: DataFrame, true: DataFrame) -> DataFrame:
    """(seq_id, matched, cost, false_alarms, misses): one-to-one matching of index lists (seq_id, t) with the least total distance.

    On a line some best matching keeps the order, so a small table over both lists is enough.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = np.sort(left["t"].to_numpy(float)), np.sort(right["t"].to_numpy(float))
        if len(a) > len(b):
            short, long = b, a
        else:
            short, long = a, b
        best = np.full((len(short) + 1, len(long) + 1), np.inf)
        best[0] = 0
        for i in range(1, len(short) + 1):
            for j in range(i, len(long) + 1):
                best[i, j] = min(best[i, j - 1], best[i - 1, j - 1] + abs(short[i - 1] - long[j - 1]))
        who = (left if len(left) else right)["seq_id"].iloc[0]
        k = len(short)
        return pd.DataFrame({"seq_id": [who], "matched": [k], "cost": [float(best[k, len(long)])], "false_alarms": [len(a) - k], "misses": [len(b) - k]})

    return pred.select("seq_id", "t").groupBy("seq_id").cogroup(_fresh(true, "seq_id", "t").groupBy("seq_id")).applyInPandas(run, "seq_id long, matched long, cost double, false_alarms long, misses long")
