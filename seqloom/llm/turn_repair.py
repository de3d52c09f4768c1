"""Repair of conversation structure by cheapest edits, streamed turn by turn.

Rows are repartitioned by conversation and sorted by turn, latest first, and read as a stream: what
is carried from row to row, and so from one Arrow batch to the next, is the cost of the cheapest
repair of everything that follows, for each of four states (nothing yet, after system, after user,
after assistant). Each row leaves one byte, the best edit in each state. When the first turn of a
conversation is reached these bytes are followed forwards, from the start state, and give the
edits; since costs are known to the end of the conversation, taking the least letter among equally
cheap ones at each step gives the least of all cheapest edit strings.

The bytes, with the roles and texts that the repaired conversation is written from, are kept in
blocks of ``block_bytes``; full blocks go to a scratch file of the task, which is read backwards and
goes with the task. So memory does not grow with a conversation, whatever share of all rows it has.
One task must see a conversation in order, as its digest is a running one; all that need not be done
in order is not: which rows repeat an earlier one is found beforehand, by sums over (conversation,
role, digest of the text), so the rows of a large conversation are spread over all tasks there.

Faults, costs and edits: a row is blank (nothing but white space), a duplicate (role and text seen
earlier in the conversation) or truncated (its last character other than white space is not one of
``. ! ?``), whichever comes first. Keep (K) costs nothing, Rerole (R) to user or assistant
``rerole``, Delete (D) ``delete``, Insert (I) of an empty user or assistant turn ``insert``; blank
and duplicate rows must go, and a truncated row that stays costs ``truncated`` more. The roles that
remain have the initials ``(s?(ua)+)?``.

Defined results: null roles and texts are one space; a role without characters can't be kept; null
turns come first; rows of equal turn come in the order of role and text, so equal rows are
neighbours and all but one of them are duplicates; rows without a conversation id are one
conversation; a text of any length is kept whole; an empty table gives no rows; only the operator's
own columns are returned, whatever others ``turns`` has.
"""

from __future__ import annotations

import hashlib
import marshal
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where each state goes with a role's initial, and what role each state waits for.
TAKES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = (USER, USER, ASSISTANT, USER)
LETTERS = "DIKR"  # in ASCII order
LEGAL = {"su", "ua", "au"}
FAR = 1 << 40
GOOD, GONE, CUT = range(3)  # a row without a fault, one that must go, a truncated one

REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, position long, edit string, turn long, role string, text string"


@dataclass(frozen=True)
class EditCosts:
    """Costs of the edits, and how much of a conversation is kept in memory."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5
    block_bytes: int = 4 << 20


def _with_inserts(base: list[int], p: EditCosts) -> tuple[int, ...]:
    """Costs from each state once turns may be inserted before anything else happens."""
    user, assistant = min(base[USER], p.insert + base[ASSISTANT]), min(base[ASSISTANT], p.insert + base[USER])
    return min(base[START], p.insert + user), min(base[SYSTEM], p.insert + user), user, assistant


def at_end(p: EditCosts) -> tuple[int, ...]:
    """Costs from each state when no row is left."""
    return _with_inserts([0, FAR, FAR, 0], p)


@lru_cache(100_000)
def step(ahead: tuple[int, ...], initial: str, kind: int, p: EditCosts) -> tuple[int, tuple[int, ...], int]:
    """One row further back: what all states pay more, their costs less that, and the best letter of each, two bits a state.

    ``ahead`` are the costs after the row, the least of them 0, so there are few different calls.
    """
    stays = p.truncated if kind == CUT else 0
    base, moves = [], []
    for s in range(4):
        ways = {"D": p.delete + ahead[s]}
        if kind != GONE:
            if (s, initial) in TAKES:
                ways["K"] = stays + ahead[TAKES[s, initial]]
            ways["R"] = p.rerole + stays + ahead[NEXT[s]]
        base.append(min(ways.values()))
        moves.append(ways)
    costs = _with_inserts(base, p)
    byte = 0
    for s in range(4):
        moves[s]["I"] = p.insert + costs[NEXT[s]]
        byte |= LETTERS.index(min(x for x, c in moves[s].items() if c == costs[s])) << 2 * s
    least = min(costs)
    return least, tuple(c - least for c in costs), byte


class _Conversation:
    """What is carried through one conversation, from its last row to its first."""

    def __init__(self, conv_id: int | None, p: EditCosts) -> None:
        self.conv_id, self.p = conv_id, p
        self.ahead, self.paid = at_end(p), 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.later = None
        self.bytes, self.rows, self.size = bytearray(), [], 0
        self.file, self.blocks = None, []

    def add(self, turn: int | None, role: str, text: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        kind = GONE if blank or duplicate else CUT if truncated else GOOD
        self.blank += blank
        self.duplicate += duplicate and not blank
        self.truncated += kind == CUT
        if turn is not None:
            self.turns += self.first is None or turn != self.first
            self.first, self.last = turn, turn if self.last is None else self.last
        if self.later is not None:
            self.illegal += role[:1] + self.later not in LEGAL
        self.later = role[:1]
        more, self.ahead, byte = step(self.ahead, role[:1], kind, self.p)
        self.paid += more
        self.bytes.append(byte)
        self.rows.append((turn, role, text))
        self.size += len(text) + len(role) + 64
        if self.size >= self.p.block_bytes:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        data = marshal.dumps((bytes(self.bytes), self.rows))
        self.blocks.append((self.file.seek(0, 2), len(data)))
        self.file.write(data)
        self.bytes, self.rows, self.size = bytearray(), [], 0

    def _forwards(self) -> Iterator[tuple[int, tuple[int | None, str, str]]]:
        yield from zip(reversed(self.bytes), reversed(self.rows), strict=True)
        for at, size in reversed(self.blocks):
            self.file.seek(at)
            steps, rows = marshal.loads(self.file.read(size))
            yield from zip(reversed(steps), reversed(rows), strict=True)

    def repaired(self) -> Iterator[tuple[str, int | None, str, str]]:
        """(edit, turn, role, text) in order; of a deleted row the role and text that it had."""
        state, waits = START, {USER: "user", ASSISTANT: "assistant"}
        for byte, (turn, role, text) in self._forwards():
            while (letter := LETTERS[byte >> 2 * state & 3]) == "I":
                state = NEXT[state]
                yield "I", None, waits[state], ""
            if letter == "K":
                state = TAKES[state, role[:1]]
            elif letter == "R":
                state = NEXT[state]
                role = waits[state]
            yield letter, turn, role, text
        while state in (SYSTEM, USER):
            state = NEXT[state]
            yield "I", None, waits[state], ""

    def report(self) -> tuple:
        """The row of ``REPORT``."""
        audit, digest, between = [], hashlib.sha256(), b""
        for edit, _, role, text in self.repaired():
            audit.append(edit)
            if edit != "D":
                digest.update(between + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                between = b"\n"
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.paid + self.ahead[START], "".join(audit), digest.hexdigest()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _conversations(batches: Iterator[pa.RecordBatch], p: EditCosts) -> Iterator[_Conversation]:
    """The conversations of a partition, each once its first row has been read."""
    now, held = None, None

    def settle(earlier: tuple | None) -> None:
        # of equal neighbours all but the earliest repeat it
        _, turn, role, text, blank, later, truncated = held
        now.add(turn, role, text, blank, later or (earlier is not None and earlier[:4] == held[:4]), truncated)

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "blank", "later", "truncated")], strict=True):
            if held is not None:
                settle(row)
            if now is None or held[0] != row[0]:
                if now is not None:
                    yield now
                    now.close()
                now = _Conversation(row[0], p)
            held = row
    if now is not None:
        settle(None)
        yield now
        now.close()


def _dealt(turns: DataFrame) -> DataFrame:
    """Rows with their faults, by conversation and latest first; ``later``: role and text stand in an earlier turn."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")  # null turns first
    digest = F.sha2("text", 256)
    repeated = rows.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), digest.alias("_d")).agg(F.count("*").alias("_k"), F.min(order).alias("_first")).filter("_k > 1")
    shown = F.rtrim(F.col("text"), F.lit(WHITE))
    faults = rows.withColumn("_digest", digest).join(repeated, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("_digest") == F.col("_d")), "left").select(
        "conv_id", "turn", "role", "text", (shown == "").alias("blank"), F.coalesce(order > F.col("_first"), F.lit(False)).alias("later"),
        (~F.right(shown, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    return faults.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc())


def _rows(found: Iterator[tuple], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``most`` bytes of text."""
    rows, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for row in found:
        rows.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size >= most:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.large_string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def repair_report(turns: DataFrame, p: EditCosts = EditCosts()) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text), as in ``REPORT``: faults, the cost and letters of its edits and the digest of its repaired text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows((c.report() for c in _conversations(batches, p)), _schema(REPORT), p.block_bytes)

    return _dealt(turns).mapInArrow(run, REPORT)


def repaired_turns(turns: DataFrame, p: EditCosts = EditCosts()) -> DataFrame:
    """The repaired conversations, one row per turn, as in ``TURNS``: position from 0, the edit that made it (K, R or I), and the turn it comes from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kept() -> Iterator[tuple]:
            for c in _conversations(batches, p):
                left = (x for x in c.repaired() if x[0] != "D")
                yield from ((c.conv_id, i, *x) for i, x in enumerate(left))

        yield from _rows(kept(), _schema(TURNS), p.block_bytes)

    return _dealt(turns).mapInArrow(run, TURNS)


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with rows dropped, emptied, cut, repeated or relabelled by a checksum of conversation and turn."""
    shown = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fate = F.crc32(F.concat(shown["conv_id"], F.lit(":"), shown["turn"]).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", shown["role"].alias("role"), shown["text"].alias("text"), fate.alias("_fate")).filter("_fate <> 0")
    text = F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fate") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_fate") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_copy")).drop("_copy")
