"""Relations between states and goals, and guards on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions.graphs import grouped_components
from seqloom.functions.tables import numbered
from seqloom.operators.states import component_signature
from seqloom.storage import stored


def one_block_transitions(states: DataFrame, blocks: int) -> DataFrame:
    """(src, dst, prob): the next state adds parts of one block only (block: part modulo ``blocks``); rows normalised.

    For each block a state is indexed by its parts outside the block, which both states share, and its least part inside it
    (-1 where it has none), which the next state must have too; only then are the parts inside compared. A state with k
    parts in a block is looked up k + 1 times, not once a subset.
    """
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    split = states.select("state_id", F.array_sort(F.array_distinct("parts")).alias("parts"), block)
    within = lambda x: x % blocks == F.col("block")
    split = split.select("state_id", "block", F.filter("parts", lambda x: ~within(x)).alias("outer"), F.filter("parts", within).alias("inner"))
    lower = split.select(F.col("state_id").alias("src"), "block", "outer", F.coalesce(F.get("inner", F.lit(0)), F.lit(-1)).alias("anchor"), F.col("inner").alias("less"))
    none = F.array(F.lit(-1))
    upper = split.filter(F.size("inner") > 0).select(F.col("state_id").alias("dst"), "block", "outer", F.col("inner").alias("more"), F.explode(F.concat(none, "inner")).alias("anchor"))
    met = lower.join(upper, ["block", "outer", "anchor"]).filter((F.size("less") < F.size("more")) & (F.size(F.array_except("less", "more")) == 0))
    pairs = met.select("src", "dst")
    return pairs.withColumn("prob", 1 / F.count("*").over(Window.partitionBy("src")))


def component_state_scores(signatures: DataFrame, features: DataFrame) -> DataFrame:
    """(state_id, s, log_prob): sum of same-component signature times feature over pairs (state_id, a, b), and its log-softmax over all states.

    The softmax needs two sums over all states, which are made beforehand on every partition; no states are gathered.
    """
    return _with_log_prob(_signed_sums(signatures, features))


def joint_state_scores(joints: DataFrame, features: DataFrame) -> DataFrame:
    """``component_state_scores`` of the signatures that joints (state_id, a, b) have, without a row for each pair of parts.

    A state's components, an array, meet its features on the state alone; only those of large states are met pair by pair.
    """
    small, rest = grouped_components(joints, "state_id")
    both = small.join(features.select("state_id", "a", "b", "value").filter("a <> b"), "state_id")
    one, two = (lambda g: F.array_contains(g, F.col("a"))), (lambda g: F.array_contains(g, F.col("b")))
    known = both.filter(F.exists("groups", one) & F.exists("groups", two))
    sums = known.groupBy("state_id").agg(F.sum(F.when(F.exists("groups", lambda g: one(g) & two(g)), F.col("value")).otherwise(-F.col("value"))).alias("s"))
    if rest is not None:
        sums = sums.unionByName(_signed_sums(component_signature(rest), features))
    return _with_log_prob(sums)


def _signed_sums(signatures: DataFrame, features: DataFrame) -> DataFrame:
    pair = features.select("state_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "value")
    return signatures.join(pair, ["state_id", "a", "b"]).groupBy("state_id").agg(F.sum(F.col("same") * F.col("value")).alias("s"))


def _with_log_prob(sums: DataFrame) -> DataFrame:
    s = stored(sums)
    top = s.agg(F.max("s").alias("_top"))
    norm = s.join(F.broadcast(top)).agg((F.first("_top") + F.log(F.sum(F.exp(F.col("s") - F.col("_top"))))).alias("_norm"))  # one row
    return s.join(F.broadcast(norm)).select("state_id", "s", (F.col("s") - F.col("_norm")).alias("log_prob"))  # one row


def distinct_signatures(signatures: DataFrame) -> DataFrame:
    """(state_id, pairs): the different sets of connected pairs (a, b) among signatures (state_id, a, b, same), each under its least id, in order of a, b."""
    pairs = F.array_sort(F.collect_list(F.when(F.col("same") == 1, F.struct("a", "b"))))
    return signatures.groupBy("state_id").agg(pairs.alias("pairs")).groupBy("pairs").agg(F.min("state_id").alias("state_id")).select("state_id", "pairs")


class FrameScores:
    """Every frame against every state by component: the states need not fit a row, nor frames times states a table.

    ``features`` are (seq_id, t, a, b, value), one row a pair of parts in either order; repeated pairs add up, a null value
    or part counts as 0. ``states`` are (state_id, pairs) with an array of connected pairs, ids being unique. A state's score at a
    frame is the sum of values over connected pairs less that over all others, the pairs that only frames have included.
    That is twice the first sum less the whole, so only connected pairs are visited. The result is multiplied by ``scale``
    at last, so that whole numbers as values give the same scores, and ties, in any order of addition.

    States are numbered and dealt into blocks of ``block`` states. A frame meets each block in a join on (block, slice),
    where a slice is a share of frames, so no key is hot; it leaves a block as one row of scores that is reduced
    to its maximum, its sum of exponentials and its best state before anything is shuffled. Only one row a frame
    and block moves, and one row a frame comes back for the log-probabilities, which are worked out anew where they are needed.
    """

    def __init__(self, features: DataFrame, states: DataFrame, scale: float = 1.0, block: int = 1024, slices: int = 64):
        self.scale, self.slices = scale, slices
        wide = states.select("state_id", F.explode_outer(F.transform("pairs", lambda p: F.struct(F.least(p["a"], p["b"]).alias("a"), F.greatest(p["a"], p["b"]).alias("b")))).alias("_pair"))
        vocabulary = stored(numbered(wide.filter("_pair is not null").select("_pair.a", "_pair.b").distinct(), "_k", "a", "b"))
        ids = stored(numbered(states.select("state_id").distinct(), "_n", "state_id"))
        at = wide.select("state_id", "_pair.*").join(vocabulary, ["a", "b"], "left").groupBy("state_id").agg(F.collect_set(F.col("_k").cast("int")).alias("at"))
        dealt = at.join(ids, "state_id").withColumn("block", F.expr(f"_n div {block}"))
        self.blocks = stored(dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("state_id", "at"))).alias("states")))
        self.n_blocks = self.blocks.count()
        self.frames = stored(self._vectors(features, vocabulary))

    def _vectors(self, features: DataFrame, vocabulary: DataFrame) -> DataFrame:
        """(seq_id, t, whole, values): the sum of a frame's values, and those of the vocabulary as an array by number."""
        pair = features.select("seq_id", "t", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("value")).alias("value"))
        known = pair.join(vocabulary, ["a", "b"], "left").repartition("seq_id", "t")
        once = known.groupBy("seq_id", "t", "_k").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))
        entry = F.when(F.col("_k").isNotNull(), F.struct(F.col("_k").cast("int").alias("k"), F.col("value").cast("double").alias("v")))
        frame = once.groupBy("seq_id", "t").agg(F.sum("value").alias("whole"), F.array_sort(F.collect_list(entry)).alias("_e"))
        before = F.concat(F.array(F.lit(-1)), F.transform("_e", lambda e: e["k"]))
        filled = F.zip_with(F.col("_e"), F.slice(before, F.lit(1), F.size("_e")), lambda e, p: F.concat(F.array_repeat(F.lit(0.0), e["k"] - p - 1), F.array(e["v"])))
        return frame.select("seq_id", "t", "whole", F.flatten(filled).alias("values"))

    def _met(self, frames: DataFrame) -> DataFrame:
        """Frames beside each block, with ``s``: an array of (s, state_id) of the block."""
        if self.n_blocks == 0:
            return frames.withColumn("s", F.array().cast("array<struct<s:double,state_id:bigint>>")).limit(0)
        dealt = frames.withColumn("_slice", F.pmod(F.xxhash64("seq_id", "t"), F.lit(self.slices))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(self.n_blocks - 1)).cast("array<bigint>")))
        spread = self.blocks.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(self.slices - 1)).cast("array<bigint>")))
        both = dealt.join(spread, ["block", "_slice"])
        inside = lambda at: F.aggregate(at, F.lit(0.0), lambda acc, k: acc + F.coalesce(F.get(F.col("values"), k), F.lit(0.0)))
        return both.withColumn("s", F.transform("states", lambda x: F.struct(((2 * inside(x["at"]) - F.col("whole")) * F.lit(self.scale)).alias("s"), x["state_id"].alias("state_id")))).drop("states", "values", "_slice")

    def best(self) -> DataFrame:
        """(seq_id, t, state_id, s, log_prob): each frame's best state, the least id among equals, and its log-softmax over all states."""
        top = F.array_max(F.transform("s", lambda x: x["s"]))
        met = self._met(self.frames).select("seq_id", "t", "s", top.alias("top"))
        part = met.select("seq_id", "t", "top", F.aggregate("s", F.lit(0.0), lambda acc, x: acc + F.exp(x["s"] - F.col("top"))).alias("mass"), F.array_min(F.transform(F.filter("s", lambda x: x["s"] == F.col("top")), lambda x: x["state_id"])).alias("state_id"))
        highest = part.withColumn("_m", F.max("top").over(Window.partitionBy("seq_id", "t")))
        norm = F.log(F.sum(F.col("mass") * F.exp(F.col("top") - F.col("_m"))))
        return highest.groupBy("seq_id", "t").agg(F.min(F.when(F.col("top") == F.col("_m"), F.col("state_id"))).alias("state_id"), F.max("_m").alias("s"), (-norm).alias("log_prob"))

    def all(self) -> DataFrame:
        """(seq_id, t, state_id, s, log_prob): every frame and state."""
        norms = stored(self.best().select("seq_id", "t", (F.col("s") - F.col("log_prob")).alias("_norm")))
        rows = self._met(self.frames.join(norms, ["seq_id", "t"])).select("seq_id", "t", "_norm", F.explode("s").alias("x"))
        return rows.select("seq_id", "t", "x.state_id", "x.s", (F.col("x.s") - F.col("_norm")).alias("log_prob"))


def goal_agreement(states: DataFrame, goal: list) -> DataFrame:
    """(n, agree): how often truth and pred agree on being a part of the goal."""
    inside = lambda c: F.size(F.array_except(c, F.array(*[F.lit(x) for x in goal]))) == 0
    return states.agg(F.count("*").alias("n"), F.sum((inside("truth") == inside("pred")).cast("long")).alias("agree"))


def layer_agreement(blocks: DataFrame, goal: DataFrame) -> DataFrame:
    """(seq_id, layers_right): whether every layer below the highest one begun equals the goal's layer; rows are (seq_id, layer, part)."""
    want = goal.groupBy("layer").agg(F.sort_array(F.collect_set("part")).alias("_goal"))
    have = blocks.groupBy("seq_id", "layer").agg(F.sort_array(F.collect_set("part")).alias("_have"))
    top = F.max("layer").over(Window.partitionBy("seq_id"))
    marked = have.withColumn("_top", top).join(want, "layer", "left")
    below = F.col("layer") < F.col("_top")
    right = F.min(F.when(below, (F.col("_have") == F.col("_goal")).cast("int")))
    out = marked.groupBy("seq_id", "_top").agg(F.coalesce(right, F.lit(1)).alias("_ok"), F.sum(below.cast("int")).alias("_k"))
    return out.select("seq_id", ((F.col("_ok") == 1) & (F.col("_k") == F.col("_top"))).alias("layers_right"))


def not_all_equal(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n) of keys whose values differ: empty where the guard holds."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n")).filter("n > 1")


def equal_columns(*columns: str) -> Column:
    """Whether all columns of a row are equal, nulls included."""
    first, *rest = columns
    out = F.lit(True)
    for c in rest:
        out = out & F.col(first).eqNullSafe(F.col(c))
    return out
