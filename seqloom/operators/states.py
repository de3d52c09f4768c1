"""Vocabularies and assembly states; a state is a sorted array of parts, so equality and grouping work on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions.graphs import components_by_rounds, grouped_components
from seqloom.functions.tables import numbered
from seqloom.storage import discard, stored


def build_vocab(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, id): ids in order of first appearance; numbered over distinct keys only."""
    first = df.groupBy(key).agg(F.min(order).alias("_o"))
    return first.select(key, (F.row_number().over(Window.orderBy("_o", key)) - 1).alias("id"))


def sorted_vocab(df: DataFrame, key: str, background: str = "") -> DataFrame:
    """(key, id): names in order from 1, the background at 0."""
    names = df.select(key).filter(F.col(key) != background).distinct()
    numbered = names.select(key, F.row_number().over(Window.orderBy(key)).alias("id"))
    return numbered.unionByName(df.sparkSession.range(1).select(F.lit(background).alias(key), F.lit(0).alias("id")))


def compact_vocab(frames: DataFrame, seen: DataFrame, label: str) -> DataFrame:
    """``frames`` with labels numbered anew among those that ``seen`` holds; others get the vocabulary's size."""
    known = seen.select(F.col(label).alias("_l")).distinct()
    ids = known.select("_l", (F.row_number().over(Window.orderBy("_l")) - 1).alias("_i"))
    size = known.agg(F.count("*").cast("int").alias("_n"))
    return frames.join(ids, F.col(label) == F.col("_l"), "left").join(F.broadcast(size)).withColumn(label, F.coalesce("_i", "_n")).drop("_l", "_i", "_n")  # one row


def cumulative_states(actions: DataFrame) -> DataFrame:
    """(seq_id, step, state): the parts touched up to each action."""
    upto = Window.partitionBy("seq_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return actions.select("seq_id", "step", F.array_sort(F.collect_set("part").over(upto)).alias("state"))


def assembly_states(actions: DataFrame) -> DataFrame:
    """(seq_id, step, state) of connect (1) and disconnect (-1) actions; others (0) leave the state as it is.

    A part is in the state from an action that connects it to the next one that disconnects it. These
    spans are laid out over the actions, so the work is that of writing the states down.
    """
    order = Window.partitionBy("seq_id").orderBy("step")
    placed = actions.select("seq_id", "step", "op", "part", F.row_number().over(order).alias("_i"), F.count("*").over(Window.partitionBy("seq_id")).alias("_n"))
    turns = placed.filter("op <> 0").withColumn("_next", F.lead("_i").over(Window.partitionBy("seq_id", "part").orderBy("_i")))
    there = turns.filter("op = 1").select("seq_id", "part", F.explode(F.sequence("_i", F.coalesce(F.col("_next") - 1, F.col("_n").cast("int")))).alias("_i"))
    held = there.groupBy("seq_id", "_i").agg(F.array_sort(F.collect_set("part")).alias("state"))
    return placed.select("seq_id", "step", "_i").join(held, ["seq_id", "_i"], "left").select("seq_id", "step", F.coalesce("state", F.array().cast("array<int>")).alias("state"))


def transition_labels(states: DataFrame) -> DataFrame:
    """(seq_id, step, before, state): each state with the one before it, the empty state first."""
    before = F.lag("state").over(Window.partitionBy("seq_id").orderBy("step"))
    return states.withColumn("before", F.coalesce(before, F.array().cast("array<int>")))


def action_from_transition(a: Column, b: Column) -> Column:
    """The one part in which two states differ; null if they are equal or differ in more."""
    diff = F.array_union(F.array_except(a, b), F.array_except(b, a))
    return F.when(F.size(diff) == 1, diff[0])


def signed_difference(a: Column, b: Column) -> Column:
    """(sign, parts): b less a if a is part of b (1), a less b if b is part of a (-1), none if equal (0); else sign null."""
    gone, new = F.array_except(a, b), F.array_except(b, a)
    sign = F.when((F.size(gone) == 0) & (F.size(new) == 0), 0).when(F.size(gone) == 0, 1).when(F.size(new) == 0, -1)
    return F.struct(sign.alias("sign"), F.array_sort(F.when(F.size(gone) == 0, new).otherwise(gone)).alias("parts"))


def state_leq(a: Column, b: Column) -> Column:
    """Whether all of a is in b."""
    return F.size(F.array_except(a, b)) == 0


def union_states(a: Column, b: Column) -> Column:
    """All parts of both."""
    return F.array_sort(F.array_union(a, b))


def conflicting_joints(joints: DataFrame) -> DataFrame:
    """(joint) that is defined in more than one way (joint, attrs)."""
    return joints.groupBy("joint").agg(F.count_distinct("attrs").alias("_n")).filter("_n > 1").select("joint")


def equal_upto(a: Column, b: Column, ignored: list) -> Column:
    """Whether two states differ in ignored parts only."""
    diff = F.array_union(F.array_except(a, b), F.array_except(b, a))
    return F.size(F.array_except(diff, F.array(*[F.lit(x) for x in ignored]))) == 0


def symmetry_class(state: Column, mapping: dict[int, int]) -> Column:
    """The state with interchangeable parts renamed to their class, sorted, repeats kept."""
    names = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.array_sort(F.transform(state, lambda x: F.coalesce(names[x], x)))


def undirected(joints: Column) -> Column:
    """Joints (a, b) without direction, each once."""
    turned = F.transform(joints, lambda j: F.struct(F.least(j["a"], j["b"]).alias("a"), F.greatest(j["a"], j["b"]).alias("b")))
    return F.array_sort(F.array_distinct(turned))


def remove_joint(joints: Column, a: Column, b: Column) -> Column:
    """The joints less one."""
    return F.filter(joints, lambda j: ~((j["a"] == a) & (j["b"] == b)))


def links_of(joints: Column) -> Column:
    """The parts that some joint holds."""
    return F.array_sort(F.array_distinct(F.concat(F.transform(joints, lambda j: j["a"]), F.transform(joints, lambda j: j["b"]))))


def enumerate_states(finals: DataFrame, possible: Column | None = None, max_rounds: int = 64) -> DataFrame:
    """(parts): every state reachable from the final ones by taking parts away; ``possible`` is the rule a state must meet."""
    frontier = stored(finals.select(F.array_sort("parts").alias("parts")).distinct())
    seen = frontier
    for _ in range(max_rounds):
        smaller = frontier.select("parts", F.explode("parts").alias("_p")).select(F.array_except("parts", F.array("_p")).alias("parts")).distinct()
        if possible is not None:
            smaller = smaller.filter(possible)
        frontier = stored(smaller.join(seen, "parts", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = stored(seen.unionByName(frontier))
    raise RuntimeError("states did not settle")


def component_signature(joints: DataFrame) -> DataFrame:
    """(state_id, a, b, same): for each pair of parts of a state whether joints connect them; +1 or -1. All states at once."""
    small, rest = grouped_components(joints, "state_id")
    parts = F.flatten(F.transform("groups", lambda g: F.transform(g, lambda v: F.struct(v.alias("v"), F.array_min(g).alias("l")))))
    first = small.select("state_id", parts.alias("p")).select("state_id", "p", F.explode("p").alias("x"))
    pairs = first.select("state_id", "x", F.explode("p").alias("y")).select("state_id", F.col("x.v").alias("a"), F.col("y.v").alias("b"), F.col("x.l").alias("la"), F.col("y.l").alias("lb"))
    if rest is not None:
        label = components_by_rounds(rest, "state_id")
        one, two = label.select("state_id", F.col("v").alias("a"), F.col("l").alias("la")), label.select("state_id", F.col("v").alias("b"), F.col("l").alias("lb"))
        pairs = pairs.unionByName(one.join(two, "state_id"))
    return pairs.filter("a < b").select("state_id", "a", "b", F.when(F.col("la") == F.col("lb"), 1).otherwise(-1).alias("same"))


def adjacency(joints: DataFrame) -> DataFrame:
    """(state_id, lo, hi): the undirected edges of each state."""
    return joints.select("state_id", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()


def edges_to_assembly(frames: DataFrame, patterns: DataFrame, key: str = "edges") -> DataFrame:
    """Frames with the id of the first pattern (edges, id) equal to their edge vector; new vectors are numbered on behind, in order."""
    first = patterns.groupBy(key).agg(F.min("id").alias("_id"))
    new = frames.select(key).distinct().join(first, key, "left_anti")
    base = patterns.agg(F.max("id").alias("_m"))
    more = numbered(new, "_r", key).join(F.broadcast(base)).select(key, (F.col("_m") + F.col("_r") + 1).alias("_id"))  # one row
    return frames.join(first.unionByName(more), key).withColumnRenamed("_id", "assembly")


def connected_mask(intervals: DataFrame, joints: DataFrame) -> DataFrame:
    """(seq_id, start, end, device): devices with a joint in the state that holds over an interval (state_id)."""
    touched = joints.select("state_id", F.explode(F.array("a", "b")).alias("device")).distinct()
    return intervals.join(touched, "state_id").select("seq_id", "start", "end", "device")


def propagate_poses(roots: DataFrame, joints: DataFrame, max_rounds: int = 64, tolerance: float = 1e-9) -> DataFrame:
    """(state_id, part, x, y, z) from root parts along joints (state_id, parent, child, dx, dy, dz); parts that no root reaches are left out.

    Every part that waits for a place points at one parent, a placed one if it has any. Pointers then jump to the pointer's
    pointer and add up their offsets, so a chain of n joints takes about log n rounds; when no more of them end at a placed
    part, those that do are placed. Only parts that had pointed at an unreachable parent take another pass. At the end
    all joints are held against the places: one that puts a placed part elsewhere, by more than ``tolerance``, is a ValueError, and
    so is a root with two places. Tables of earlier rounds are deleted.
    """
    moves = ["dx", "dy", "dz"]
    placed = stored(roots.select("state_id", "part", "x", "y", "z").distinct())
    if placed.groupBy("state_id", "part").count().filter("count > 1").head(1):
        raise ValueError("a root has two places")
    known = stored(joints.select("state_id", "parent", "child", *moves).dropna().distinct())
    for _ in range(max_rounds):
        at = placed.select("state_id", "part", F.lit(True).alias("rooted"))
        waiting = known.filter("parent <> child").join(at.select("state_id", F.col("part").alias("child")), ["state_id", "child"], "left_anti")
        ends = waiting.join(at.withColumnRenamed("part", "parent"), ["state_id", "parent"], "left").withColumn("rooted", F.coalesce("rooted", F.lit(False)))
        one = F.min(F.struct(~F.col("rooted"), F.col("parent").alias("ptr"), *moves, "rooted")).alias("_j")
        links = stored(ends.groupBy("state_id", F.col("child").alias("part")).agg(one).select("state_id", "part", "_j.ptr", *[f"_j.{c}" for c in moves], "_j.rooted"))
        settled = links.filter("rooted").count()
        if settled == 0:
            discard(links)
            break
        links, settled = _jumped(links, settled, moves)
        base = placed.select("state_id", F.col("part").alias("ptr"), "x", "y", "z")
        found = links.filter("rooted").join(base, ["state_id", "ptr"]).select("state_id", "part", *[(F.col(c) + F.col("d" + c)).alias(c) for c in "xyz"])
        more = stored(placed.unionByName(found))
        discard(placed)
        discard(links)
        placed = more
    else:
        raise RuntimeError("poses did not settle")
    parent = placed.select("state_id", F.col("part").alias("parent"), *[F.col(c).alias("_" + c) for c in "xyz"])
    child = placed.select("state_id", F.col("part").alias("child"), "x", "y", "z")
    off = F.greatest(*[F.abs(F.col("_" + c) + F.col("d" + c) - F.col(c)) for c in "xyz"])
    if known.join(parent, ["state_id", "parent"]).join(child, ["state_id", "child"]).filter(off > tolerance).head(1):
        raise ValueError("two joints place a part differently")
    discard(known)
    return placed


def _jumped(links: DataFrame, settled: int, moves: list[str]) -> tuple[DataFrame, int]:
    """Pointers (state_id, part, ptr, offsets, rooted) moved on by doubling until no more of them end at a placed part; each distance
    up to the longest has a part, so a round that settles none is the last."""
    while True:
        step = links.select("state_id", F.col("part").alias("ptr"), F.col("ptr").alias("_ptr"), *[F.col(c).alias("_" + c) for c in moves], F.col("rooted").alias("_rooted"))
        added = [(F.col(c) + F.coalesce(F.col("_" + c), F.lit(0.0))).alias(c) for c in moves]
        on = links.join(step, ["state_id", "ptr"], "left")
        new = stored(on.select("state_id", "part", F.coalesce("_ptr", "ptr").alias("ptr"), *added, F.coalesce("_rooted", "rooted").alias("rooted")))
        discard(links)
        now = new.filter("rooted").count()
        if now == settled:
            return new, now
        links, settled = new, now


def branch_states(actions: DataFrame, classes: DataFrame, steps: int | None = None) -> DataFrame:
    """(seq_id, step, state): all states possible when a part named by class may be any of its members (cls, part).

    Connecting (1) needs a free member, disconnecting (-1) one in use; others (0) leave the state as it is. Several actions at
    a step are alternatives. A sequence has no states from an impossible action or a missing step on, nor from ``steps`` on.

    One fold a sequence carries the set of its states over its actions, so the plan doesn't grow with the longest sequence;
    a sequence, its actions and the states of all its steps are one row.
    """
    members = classes.filter("cls is not null and part is not null").groupBy("cls").agg(F.collect_set("part").alias("members"))
    known = actions.filter("step >= 0" if steps is None else f"step >= 0 and step < {steps}").select("seq_id", "step", "cls", "op").join(members, "cls", "left")
    choice = F.struct("op", F.coalesce("members", F.array().cast("array<int>")).alias("members"))
    at = known.groupBy("seq_id", "step").agg(F.collect_set(choice).alias("choices"))
    fold = at.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("step", "choices"))).alias("acts"))

    def moved(state: Column, choice: Column) -> Column:
        free, used = F.filter(choice["members"], lambda m: ~F.array_contains(state, m)), F.filter(choice["members"], lambda m: F.array_contains(state, m))
        more = F.transform(free, lambda m: F.array_sort(F.array_union(state, F.array(m))))
        less = F.transform(used, lambda m: F.array_except(state, F.array(m)))
        return F.when(choice["op"] == 1, more).when(choice["op"] == -1, less).otherwise(F.array(state))

    def after(states: Column, choices: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(states, lambda s: F.flatten(F.transform(choices, lambda c: moved(s, c))))))

    start = F.struct(F.array(F.array().cast("array<int>")).alias("now"), F.array().cast("array<array<array<int>>>").alias("out"))

    def step(acc: Column, act: Column) -> Column:
        now = after(acc["now"], act["choices"])
        return F.struct(now.alias("now"), F.concat(acc["out"], F.array(now)).alias("out"))

    walk = F.aggregate(F.filter("acts", lambda x, i: x["step"] == i), start, step, lambda acc: acc["out"])
    return fold.select("seq_id", F.posexplode(walk).alias("step", "states")).select("seq_id", "step", F.explode("states").alias("state"))
