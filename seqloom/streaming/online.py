"""Operators for sensor streams. Each takes a streaming or a batch DataFrame with an event time ``ts``.

On a stream, set a watermark first (``with_lateness``); state is dropped once it has passed.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

NEVER = -1  # no row was folded yet, no timer is set
UNNAMED = -1  # the share of rows without a sequence
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_session(spark: SparkSession, state_stores: int = 16) -> SparkSession:
    """A session of the same application for streams: its own settings, at most ``state_stores`` stores for an operator, kept in RocksDB."""
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", min(state_stores, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return own


def with_lateness(stream: DataFrame, delay: str) -> DataFrame:
    """The stream with a watermark: rows later than this are dropped."""
    return stream.withWatermark("ts", delay)


def best_event_per_window(events: DataFrame, size: str) -> DataFrame:
    """(win, label, score): the highest score of each tumbling window and its label, the earlier one on a tie."""
    best = F.max(F.struct("score", (-F.unix_micros("ts")).alias("_early"), "label"))
    return events.groupBy(F.window("ts", size).alias("win")).agg(best.alias("_x")).select("win", "_x.label", "_x.score")


def sliding_pair(events: DataFrame, one: int, two: int, size: str, slide: str) -> DataFrame:
    """(win, a, b, n): mean scores of two devices in each sliding window."""
    mean = lambda c: F.avg(F.when(F.col("code") == c, F.col("score")))
    return events.groupBy(F.window("ts", size, slide).alias("win")).agg(mean(one).alias("a"), mean(two).alias("b"), F.count("*").alias("n"))


def activity_sessions(events: DataFrame, gap: str) -> DataFrame:
    """(seq_id, win, n): events of a sequence with no longer pause than ``gap``."""
    return events.groupBy("seq_id", F.session_window("ts", gap).alias("win")).agg(F.count("*").alias("n"))


def bounded_join(left: DataFrame, right: DataFrame, reach: str) -> DataFrame:
    """Rows of both with right's time at or within ``reach`` after left's; on streams both need a watermark."""
    a, b = left.withColumnRenamed("ts", "ts_left"), right.withColumnRenamed("ts", "ts_right").withColumnRenamed("seq_id", "_seq")
    on = (F.col("seq_id") == F.col("_seq")) & (F.col("ts_right") >= F.col("ts_left")) & (F.col("ts_right") <= F.col("ts_left") + F.expr(f"INTERVAL {reach}"))
    return a.join(b, on).drop("_seq")


class _InOrder(StatefulProcessor):
    """Folds the rows of a sequence in the order of time, whatever order they come in.

    Rows wait, as state of their sequence, until the watermark has passed their time; a timer then hands over all that are due. What has
    been folded so far is the rest of the state. It lasts for ``timeout`` after a row: one that comes later begins anew, and the state is
    dropped once the watermark is that far and no row waits.

    Spark calls Python once for each key and batch, and each look at state or timers is a message to the JVM. So a key is a share of the
    sequences: its state is one value, a pickled dict of its sequences, and it has one timer, for whatever is due first.
    """

    def __init__(self, order: str, begin: tuple, fold: Callable[[tuple, int, Any], tuple[tuple, tuple]], out: list[str], timeout: str) -> None:
        self.order, self.begin, self.fold, self.out = order, begin, fold, out
        self.wait = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("folded", "sequences binary, timer long")

    def _get(self) -> tuple[dict[int, list], int]:
        """[carried, last, waiting] of each sequence of the share, and when its timer goes off."""
        found = self.state.get()
        return ({}, NEVER) if found is None else (pickle.loads(bytes(found[0])), found[1])

    def _put(self, sequences: dict[int, list], timer: int) -> None:
        if sequences:
            self.state.update((pickle.dumps(sequences, pickle.HIGHEST_PROTOCOL), timer))
        else:
            self.state.clear()

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:  # noqa: N802, N803
        sequences, timer = self._get()
        carried = [c for c in initialState.columns if c not in ("share", "seq_id")]
        for seq, *values in zip(_ids(key, initialState), *[initialState[c] for c in carried], strict=True):
            sequences[seq] = [tuple(_plain(v) for v in values), NEVER, []]
        self._put(sequences, timer)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        sequences, timer = self._get()
        first = None
        for pdf in rows:
            micros = pdf["ts"].astype("datetime64[us]").astype("int64")
            first = micros.min() if first is None else min(first, micros.min())
            for seq, us, place, value in zip(_ids(key, pdf), micros.tolist(), pdf[self.order].tolist(), pdf["value"], strict=True):
                sequences.setdefault(seq, [self.begin, NEVER, []])[2].append((us, place, _plain(value)))
        if first is not None and (timer == NEVER or -(-int(first) // 1000) < timer):
            timer = self._wake(timer, -(-int(first) // 1000))
        self._put(sequences, timer)
        return iter([])

    def _wake(self, before: int, at: int) -> int:
        """The share's timer goes off at ``at`` and no longer at ``before``."""
        if before != NEVER:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        return at

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        sequences, _ = self._get()
        rows, due = [], None
        for seq, held in list(sequences.items()):
            carried, last, waiting = held
            for us, place, value in sorted((x for x in waiting if x[0] <= now * 1000), key=lambda x: x[:2]):
                if last != NEVER and us > (last + self.wait) * 1000:
                    carried = self.begin
                last = -(-us // 1000)
                carried, row = self.fold(carried, place, value)
                rows.append((seq, place, *row))
            waiting = [x for x in waiting if x[0] > now * 1000]
            if waiting or last == NEVER or last + self.wait > now:
                sequences[seq] = [carried, last, waiting]
                ends = -(-min(x[0] for x in waiting) // 1000) if waiting else last + self.wait if last != NEVER else None
                due = ends if due is None else due if ends is None else min(due, ends)
            else:
                del sequences[seq]
        timer = NEVER if due is None else self._wake(NEVER, max(due, now + 1))  # Spark deletes the one that has gone off
        self._put(sequences, timer)
        if rows:
            yield pd.DataFrame(rows, columns=self.out)

    def close(self) -> None:
        pass


def _plain(x: Any) -> Any:
    """Lists and numbers of Python, as state takes them."""
    if isinstance(x, np.ndarray):
        return x.tolist()
    if isinstance(x, np.generic):
        return x.item()
    return [_plain(y) for y in x] if isinstance(x, (list, tuple)) else x


def _ids(key: tuple, pdf: pd.DataFrame) -> list[int | None]:
    """The sequences of a share's rows; those without an id are a sequence, and a share of their own."""
    return [None] * len(pdf) if key[0] == UNNAMED else pdf["seq_id"].tolist()


def _folded(rows: DataFrame, value: Column, order: str, begin: tuple, fold: Callable, out: str, timeout: str, initial: DataFrame | None, shares: int) -> DataFrame:
    seq = F.col("seq_id").cast("long")
    share = F.when(seq.isNull(), UNNAMED).otherwise(F.pmod(F.xxhash64(seq), F.lit(shares))).cast("int").alias("share")
    keyed = rows.select(share, seq.alias("seq_id"), F.col(order).cast("long").alias(order), "ts", value.alias("value")).filter(F.col(order).isNotNull() & F.col("value").isNotNull())
    processor = _InOrder(order, begin, fold, [x.split()[0] for x in out.split(", ")], timeout)
    started = None if initial is None else initial.withColumn("seq_id", seq).select(share, *initial.columns).groupBy("share")
    return keyed.groupBy("share").transformWithStateInPandas(processor, out, "Append", "EventTime", started)


def track_states(actions: DataFrame, timeout: str = "1 hour", initial: DataFrame | None = None, shares: int = 1024) -> DataFrame:
    """(seq_id, step, state): the parts connected so far, after each action (seq_id, step, part, op, ts) of a stream with a watermark.

    Actions are taken in the order of ts and step once the watermark has passed them, in whatever batches they arrive; Spark drops and
    counts those that come later still (``numRowsDroppedByWatermark``). Rows without a step are passed over. ``initial`` has the parts (seq_id, parts) that sequences begin with.
    The session's state store must be RocksDB. Sequences are dealt into ``shares``, of which a worker holds one at a time with its state.
    """

    def fold(carried: tuple, step: int, action: list[int]) -> tuple[tuple, tuple]:
        parts, (part, op) = set(carried[0]), action
        parts = parts | {part} if op == 1 else parts - {part} if op == -1 else parts
        return (sorted(parts),), (sorted(parts),)

    value = F.array(F.col("part").cast("int"), F.col("op").cast("int"))
    return _folded(actions, value, "step", ([],), fold, "seq_id long, step int, state array<int>", timeout, initial, shares)


def forward_filter(scores: DataFrame, moves: np.ndarray, timeout: str = "1 hour", initial: DataFrame | None = None, shares: int = 1024) -> DataFrame:
    """(seq_id, t, state, log_prob): the likeliest present state given all scores (seq_id, t, score, ts) up to it; order, lateness and state store as in ``track_states``.

    ``initial`` has the log beliefs (seq_id, belief) that sequences go on from.
    """

    def fold(carried: tuple, t: int, score: list[float]) -> tuple[tuple, tuple]:
        x = np.asarray(score, float)
        belief = np.logaddexp.reduce(np.asarray(carried[0])[:, None] + moves, axis=0) + x if len(carried[0]) else x
        belief = belief - np.logaddexp.reduce(belief)
        return (belief.tolist(),), (int(belief.argmax()), float(belief.max()))

    value = F.col("score").cast("array<double>")
    return _folded(scores, value, "t", ([],), fold, "seq_id long, t int, state int, log_prob double", timeout, initial, shares)
