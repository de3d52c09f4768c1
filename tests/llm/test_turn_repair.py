"""Cheapest repairs of conversations against enumeration, and over tables with every odd case."""

import hashlib
import itertools
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from seqloom.llm.queries import op12_turn_repair
from seqloom.llm.turn_repair import EditCosts, damaged, repair_report, repaired_turns

KIND = "conv_id long, turn long, role string, text string"
FORM = re.compile(r"(s?(ua)+)?")
WHITE = " \t\n\x0b\x0c\r"


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        left = text.rstrip(WHITE)
        out.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def enumerated(rows):
    """(cost, audit, repaired rows) by trying every edit of every row with up to two inserts in each place."""
    adds = [x for n in range(3) for x in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    per_row = []
    for (_, role, text), fault in zip(rows, faults_of(rows)):
        ways = [("D", 2, [])]
        if fault in (None, "truncated"):
            more = 5 if fault else 0
            ways += [("K", more, [(role, text)])] + [("R", 1 + more, [(r, text)]) for r in ("user", "assistant")]
        per_row.append([("I" * len(a) + x, 5 * len(a) + c, [(r, "") for r in a] + y) for a in adds for x, c, y in ways])
    per_row.append([("I" * len(a), 5 * len(a), [(r, "") for r in a]) for a in adds])
    for run in itertools.product(*per_row):
        cost, audit, left = sum(x[1] for x in run), "".join(x[0] for x in run), [y for x in run for y in x[2]]
        if (best is None or (cost, audit) < best[:2]) and all(r for r, _ in left) and FORM.fullmatch("".join(r[:1] for r, _ in left)):
            best = (cost, audit, left)
    return best


def by_states(rows):
    """The same by strings carried in a table of states, for longer conversations."""
    nxt, takes = {0: 2, 1: 2, 2: 3, 3: 2}, {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    names = {2: "user", 3: "assistant"}

    def insert(table):
        for _ in range(3):
            for s in range(4):
                t = nxt[s]
                if table[t] and (not table[s] or (table[t][0] + 5, "I" + table[t][1]) < table[s][:2]):
                    table[s] = (table[t][0] + 5, "I" + table[t][1], [(names[t], ""), *table[t][2]])
        return table

    table = insert([(0, "", []), None, None, (0, "", [])])
    for (_, role, text), fault in reversed(list(zip(rows, faults_of(rows)))):
        now = []
        for s in range(4):
            ways = [(table[s][0] + 2, "D" + table[s][1], table[s][2])]
            if fault in (None, "truncated"):
                more = 5 if fault else 0
                if (s, role[:1]) in takes:
                    t = takes[s, role[:1]]
                    ways.append((table[t][0] + more, "K" + table[t][1], [(role, text), *table[t][2]]))
                t = nxt[s]
                ways.append((table[t][0] + more + 1, "R" + table[t][1], [(names[t], text), *table[t][2]]))
            now.append(min(ways, key=lambda x: x[:2]))
        table = insert(now)
    return table[0]


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, turns = faults_of(rows), [t for t, *_ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    cost, audit, left = by_states(rows)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest(),
    }


def random_rows(rng, n):
    texts = ["Yes.", "No!", "cut off", " ", "", "Why?  \n", "a.b", "Yes.", "\t"]
    roles = ["user", "assistant", "system", "tool", "", "User"]
    return [(int(rng.integers(0, n + 2)) if rng.random() < 0.9 else None, str(rng.choice(roles, p=[0.35, 0.35, 0.1, 0.1, 0.05, 0.05])), str(rng.choice(texts))) for _ in range(n)]


def test_states_agree_with_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(25):
        rows = random_rows(rng, int(rng.integers(0, 4)))
        assert by_states(rows) == enumerated(rows)


def test_repairs(spark):
    rng = np.random.default_rng(1)
    convs = {i: random_rows(rng, int(rng.integers(1, 40))) for i in range(150)}
    convs[None] = random_rows(rng, 30)
    convs[1000] = random_rows(rng, 3000) + [(5, "user", "x" * 300_000 + ".")]
    convs[1001] = [(3, "user", "Same.")] * 500
    convs[1002] = [(None, "user", None), (None, None, "Hm."), (None, "assistant", "Hm.")]
    rows = [(c, *r, "x") for c, x in convs.items() for r in x]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], KIND + ", cost string").withColumn("later", F.lit(1))
    shown = {c: [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in v] for c, v in convs.items()}
    for p in (EditCosts(), EditCosts(block_bytes=500)):  # the small blocks are spilled
        got = {r.conv_id: r.asDict() for r in repair_report(df, p).collect()}
        assert got == {c: {"conv_id": c, **expected(v)} for c, v in shown.items()}
    with_turns = {}
    for r in repaired_turns(df, EditCosts(block_bytes=500)).orderBy("position").collect():
        with_turns.setdefault(r.conv_id, []).append((r.position, r.role, r.text))
    for c, v in shown.items():
        left = by_states(sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])))[2]
        assert with_turns.get(c, []) == [(i, *x) for i, x in enumerate(left)]


def test_nothing(spark):
    empty = spark.createDataFrame([], KIND)
    assert repair_report(empty).count() == 0 and repaired_turns(empty).count() == 0 and damaged(empty).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    convs = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        rows = convs.setdefault(r.conv_id, [])
        k = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", r.text) if k == 2 else r.text
            rows += [(r.turn, "user" if k == 4 else r.role, text)] * (2 if k == 3 else 1)
    got = {r.conv_id: r.asDict() for r in op12_turn_repair(spark, sf).collect()}
    assert got == {c: {"conv_id": c, **expected(v)} for c, v in convs.items()}


def test_query_keeps_conversations_without_rows(spark, tmp_path):
    gone = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    stays = next(t for t in range(1000) if zlib.crc32(f" :{t}".encode()) % 20 > 4)
    spark.createDataFrame([(7, gone, "user", "Hi."), (None, stays, None, None)], KIND).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in op12_turn_repair(spark, str(tmp_path)).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert tuple(got[7])[1:] == (0, 0, 0, 0, 0, 0, "", nothing)
    assert tuple(got[None])[1:] == (0, 1, 0, 0, 0, 2, "D", nothing)
