"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, ending with the
assistant. An automaton of four states (nothing yet, after system, after user, after assistant)
reads the turns; each turn may be taken as it is, relabelled, merged into the turn before it, or
given an empty turn in front. The cheapest run is found by dynamic programming and then rendered,
one fragment a turn: the fragments of a conversation in order are its formatted text.

Conversations are sorted across partitions and cut into segments of at most ``segment_turns``
turns, so a conversation may be of any length: each segment is summed up by a 4 x 4 table of
cheapest costs, the tables of one conversation (one a segment) are joined to find the states at
its cuts, and every segment is then traced back on its own.

Defined results: null or unknown roles cost ``unknown`` to be given one; role names are trimmed
and lower-cased; null texts are empty; null turns come first; rows that repeat a turn are turns of
their own, in the order of role and text; rows without a conversation id form one conversation; an
empty table gives an empty result. Of equally cheap repairs the one that comes first in the order
take, merge, insert and system, user, assistant is chosen, from the end backwards. A text of any
length is kept whole; ``<|`` in it is written ``< |``, so that no text can forge a frame. Only the
operator's own columns are returned, whatever others ``turns`` has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.storage import stored

ROLES = ("system", "user", "assistant")
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
OUT = "conv_id long, position long, turn long, role string, repaired_role string, action string, inserted string, cost double, rendered string"


@dataclass(frozen=True)
class RepairParams:
    """Costs of the repairs and the frame of a rendered turn."""

    relabel: float = 3.0
    unknown: float = 1.0
    merge: float = 2.0
    insert: float = 4.0
    segment_turns: int = 2048
    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"


def arcs(p: RepairParams) -> list[tuple[int, int, int, str, float]]:
    """All moves of the automaton: state, role taken, next state, action, cost."""
    out = [(NOTHING, SYSTEM, SYSTEM, "take", 0.0), (NOTHING, USER, USER, "take", 0.0), (SYSTEM, USER, USER, "take", 0.0), (USER, ASSISTANT, ASSISTANT, "take", 0.0), (ASSISTANT, USER, USER, "take", 0.0)]
    out += [(s, s, s, "merge", p.merge) for s in (SYSTEM, USER, ASSISTANT)]
    out += [(s, ASSISTANT, ASSISTANT, "insert", p.insert) for s in (NOTHING, SYSTEM, ASSISTANT)] + [(USER, USER, USER, "insert", p.insert)]
    return out


def end_costs(p: RepairParams) -> np.ndarray:
    """What it costs to end in each state: missing turns are added empty."""
    return np.array([2 * p.insert, 2 * p.insert, p.insert, 0.0])


def _role(name: str | None) -> int:
    name = (name or "").strip().lower()
    return ROLES.index(name) + 1 if name in ROLES else 0


def _label_cost(role: int, as_role: int, p: RepairParams) -> float:
    return 0.0 if role == as_role else p.unknown if role == 0 else p.relabel


def step_table(role: int, p: RepairParams) -> np.ndarray:
    """Cheapest cost from each state to each other over one turn of this role."""
    m = np.full((4, 4), np.inf)
    for s, r, t, _, c in arcs(p):
        m[s, t] = min(m[s, t], c + _label_cost(role, r, p))
    return m


def _then(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).min(axis=1)


def segment_table(roles: list[int], p: RepairParams) -> np.ndarray:
    """Cheapest cost from each state to each other over a run of turns."""
    steps = [step_table(r, p) for r in range(4)]
    m = np.where(np.eye(4) > 0, 0.0, np.inf)
    for r in roles:
        m = _then(m, steps[r])
    return m


def trace(roles: list[int], entry: int, leave: int, p: RepairParams) -> list[tuple[int, int, str, float]]:
    """The cheapest run from ``entry`` to ``leave``: for each turn the state before it, the role, the action and its cost."""
    moves = arcs(p)
    best = np.full((len(roles) + 1, 4), np.inf)
    best[0, entry] = 0
    came = []
    for i, role in enumerate(roles):
        back: dict[int, tuple] = {}
        for s, r, t, what, c in moves:
            cost = c + _label_cost(role, r, p)
            if best[i, s] + cost < best[i + 1, t]:
                best[i + 1, t] = best[i, s] + cost
                back[t] = (s, r, what, cost)
        came.append(back)
    run, state = [], leave
    for back in reversed(came):
        run.append(back[state])
        state = back[state][0]
    return run[::-1]


def render(run: list[tuple[int, int, str, float]], texts: list[str], last_state: int | None, p: RepairParams) -> list[str]:
    """The fragment of each turn; ``last_state`` is the final state if the conversation ends here."""
    head = lambda r: f"{p.open}{ROLES[r - 1]}\n"
    other = {USER: ASSISTANT, ASSISTANT: USER}
    out = []
    for (state, role, what, _), text in zip(run, texts, strict=True):
        text = text.replace("<|", "< |")  # a text can't forge a frame
        if what == "merge":
            out.append("\n" + text)
            continue
        before = "" if state == NOTHING else p.close
        if what == "insert":
            before += head(other[role]) + p.close
        out.append(before + head(role) + text)
    if last_state is not None and out:
        out[-1] += p.close
        for r in (USER, ASSISTANT)[0 if last_state in (NOTHING, SYSTEM) else 1 if last_state == USER else 2 :]:
            out[-1] += head(r) + p.close
    return out


def _segments(turns: DataFrame, p: RepairParams) -> DataFrame:
    """(conv_id, at, turns, roles, texts): runs of at most ``segment_turns`` turns; ``at`` orders those of a conversation."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        at, key, rows, out = TaskContext.get().partitionId() << 32, None, [], []

        def seal() -> None:
            nonlocal at, rows
            if rows:
                t, r, x = zip(*rows, strict=True)
                out.append((key[0], at, list(t), list(r), list(x)))
                at, rows = at + 1, []

        for pdf in batches:
            for c, t, r, x in zip(pdf["conv_id"], pdf["turn"], pdf["role"], pdf["text"], strict=True):
                c, t = (None if pd.isna(c) else int(c)), (None if pd.isna(t) else int(t))
                if key != (c,) or len(rows) >= p.segment_turns:
                    seal()
                    key = (c,)
                rows.append((t, r, x))
            if out:
                yield pd.DataFrame(out, columns=["conv_id", "at", "turns", "roles", "texts"]).astype({"conv_id": "Int64"})
                out = []
        seal()
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "at", "turns", "roles", "texts"]).astype({"conv_id": "Int64"})

    order = ["conv_id", "turn", "role", "text"]
    dealt = turns.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    return dealt.mapInPandas(cut, "conv_id long, at long, turns array<long>, roles array<string>, texts array<string>")


def repair_roles(turns: DataFrame, p: RepairParams = RepairParams()) -> DataFrame:
    """One row per row of ``turns`` (conv_id, turn, role, text), as in ``OUT``; cost of the last turn includes turns added after it."""
    segments = stored(_segments(turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"), p))

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = [segment_table([_role(r) for r in roles], p).ravel().tolist() for roles in pdf["roles"]]
            yield pd.DataFrame({"conv_id": pdf["conv_id"].astype("Int64"), "at": pdf["at"], "n": [len(x) for x in pdf["roles"]], "m": m})

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        m = [np.array(x).reshape(4, 4) for x in pdf["m"]]
        cost, came = np.where(np.arange(4) == NOTHING, 0.0, np.inf), []
        for x in m:
            reach = cost[:, None] + x
            came.append(reach.argmin(axis=0))
            cost = reach.min(axis=0)
        leave = [int((cost + end_costs(p)).argmin())]
        for back in reversed(came):
            leave.append(int(back[leave[-1]]))
        path = leave[::-1]
        ahead = np.cumsum([0, *pdf["n"]])[:-1]
        return pd.DataFrame({"at": pdf["at"], "entry": path[:-1], "leave": path[1:], "ahead": ahead, "last": [False] * (len(m) - 1) + [True]})

    summed = segments.select("conv_id", "at", "roles").mapInPandas(tables, "conv_id long, at long, n long, m array<double>")
    cuts = summed.groupBy("conv_id").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("conv_id").alias("c"))
    long_ones = summed.join(cuts, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    at_cuts = long_ones.groupBy("conv_id").applyInPandas(states, "at long, entry int, leave int, ahead long, last boolean").withColumnRenamed("at", "a")

    def traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for conv, turns_, names, texts, entry, leave, ahead, last in zip(*[pdf[c] for c in ("conv_id", "turns", "roles", "texts", "entry", "leave", "ahead", "last")], strict=True):
                roles = [_role(r) for r in names]
                if pd.isna(entry):  # the whole conversation
                    entry, ahead, last = NOTHING, 0, True
                    leave = int((segment_table(roles, p)[NOTHING] + end_costs(p)).argmin())
                run = trace(roles, int(entry), int(leave), p)
                texts = [x or "" for x in texts]
                shown = render(run, texts, int(leave) if last else None, p)
                for i, ((_, role, what, cost), turn, name, text) in enumerate(zip(run, turns_, names, shown, strict=True)):
                    end = float(end_costs(p)[int(leave)]) if last and i == len(run) - 1 else 0.0
                    action = "relabel" if what == "take" and roles[i] != role else "merge-relabel" if what == "merge" and roles[i] != role else what
                    inserted = ROLES[(ASSISTANT if role == USER else USER) - 1] if what == "insert" else None
                    rows.append((None if pd.isna(conv) else int(conv), int(ahead) + i, None if pd.isna(turn) else int(turn), name, ROLES[role - 1], action, inserted, cost + end, text))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in OUT.split(", ")])
            yield out.astype({"conv_id": "Int64", "turn": "Int64"})

    return segments.join(at_cuts, F.col("at") == F.col("a"), "left").mapInPandas(traced, OUT)
