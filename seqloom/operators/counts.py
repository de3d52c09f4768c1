"""Count models: transitions, durations, co-occurrence, Gaussians; all as sparse long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions.ranks import order_statistics
from seqloom.functions.tables import beside
from seqloom.operators.segments import to_segments
from seqloom.storage import stored


def transition_counts(frames: DataFrame, label: str, uniform: float = 0.0, diagonal: float = 0.0) -> DataFrame:
    """(src, dst, n, prob): frame bigrams, rows normalised, 0/0 = 0.

    ``uniform`` and ``diagonal`` are added to all cells and to self-loops over the labels that occur.
    """
    before = F.lag(label).over(Window.partitionBy("seq_id").orderBy("t"))
    pairs = frames.select(before.alias("src"), F.col(label).alias("dst")).filter("src is not null").groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))
    if uniform or diagonal:
        known = frames.select(F.col(label).alias("x")).distinct()
        grid = beside(known.select(F.col("x").alias("src")), known.select(F.col("x").alias("dst")))
        extra = F.lit(uniform) + F.when(F.col("src") == F.col("dst"), diagonal).otherwise(0.0)
        pairs = grid.join(pairs, ["src", "dst"], "left").select("src", "dst", (F.coalesce("n", F.lit(0.0)) + extra).alias("n"))
    total = F.sum("n").over(Window.partitionBy("src"))
    return pairs.withColumn("prob", F.coalesce(F.try_divide("n", total), F.lit(0.0)))


def smooth_counts(frames: DataFrame, label: str, self_loop: float = 0.0, support_only: bool = False) -> DataFrame:
    """(kind, src, dst, prob): start, transition and end model; a bonus on self-loops of first and last labels, or only what occurs at all."""
    ends = frames.groupBy("seq_id").agg(F.min_by(label, "t").alias("a"), F.max_by(label, "t").alias("b"))
    moves = transition_counts(frames, label).select("src", "dst", "n")
    loops = ends.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("src")).distinct().select("src", F.col("src").alias("dst"), F.lit(self_loop).alias("n"))
    merged = moves.unionByName(loops).groupBy("src", "dst").agg(F.sum("n").alias("n")).filter("n > 0")
    starts = ends.groupBy(F.col("a").alias("dst")).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(1))
    prob = lambda w: F.lit(1.0) if support_only else F.col("n") / F.sum("n").over(w)
    out = merged.select(F.lit("move").alias("kind"), "src", "dst", prob(Window.partitionBy("src")).alias("prob"))
    none = F.lit(None).cast(frames.schema[label].dataType)
    out = out.unionByName(starts.select(F.lit("start").alias("kind"), none.alias("src"), "dst", prob(every).alias("prob")))
    return out.unionByName(ends.select(F.lit("end").alias("kind"), F.col("b").alias("src")).distinct().withColumn("dst", none).withColumn("prob", F.lit(1.0)))


def endpoint_priors(frames: DataFrame, label: str) -> DataFrame:
    """(label, start, end): share of sequences that begin and end with each label."""
    ends = frames.groupBy("seq_id").agg(F.min_by(label, "t").alias("a"), F.max_by(label, "t").alias("b"))
    both = ends.select(F.explode(F.array(F.struct(F.col("a").alias("label"), F.lit(1).alias("s"), F.lit(0).alias("e")), F.struct(F.col("b").alias("label"), F.lit(0).alias("s"), F.lit(1).alias("e")))).alias("x"))
    per = both.groupBy("x.label").agg(F.sum("x.s").alias("s"), F.sum("x.e").alias("e"))
    every = Window.partitionBy(F.lit(1))  # one row a label
    return per.select("label", (F.col("s") / F.sum("s").over(every)).alias("start"), (F.col("e") / F.sum("e").over(every)).alias("end"))


def duration_priors(frames: DataFrame, label: str, upto: float = 0.95, inclusive: bool = True) -> DataFrame:
    """(label, dur, n, prob): run lengths, cut where the slowest class's cumulative share reaches ``upto``; ``inclusive`` keeps that bin."""
    runs = to_segments(frames, label).groupBy("label", F.col("n").alias("dur")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("label")
    cdf = F.sum("n").over(by.orderBy("dur")) / F.sum("n").over(by)
    marked = runs.withColumn("_cdf", cdf)
    bound = marked.filter(F.col("_cdf") >= upto).groupBy("label").agg(F.min("dur").alias("m")).agg(F.max("m").alias("_bound"))
    kept = marked.join(F.broadcast(bound)).filter(F.col("dur") <= F.col("_bound") if inclusive else F.col("dur") < F.col("_bound"))  # one row
    return kept.withColumn("prob", F.col("n") / F.sum("n").over(by)).select("label", "dur", "n", "prob")


def class_priors(frames: DataFrame, label: str) -> DataFrame:
    """(label, prob): share of segments."""
    per = to_segments(frames, label).groupBy("label").agg(F.count("*").alias("n"))
    return per.select("label", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("prob"))


def cooccurrence(frames: DataFrame, action: str, parts: str) -> DataFrame:
    """(action, part, n): frames in which an action and a part meet; no part counts as part 0."""
    return frames.select(F.col(action).alias("action"), F.coalesce(F.col("part"), F.lit(0)).alias("part")).groupBy("action", "part").agg(F.count("*").alias("n")) if parts is None else (
        frames.select(F.col(action).alias("action"), F.explode_outer(parts).alias("part")).withColumn("part", F.coalesce("part", F.lit(0))).groupBy("action", "part").agg(F.count("*").alias("n")))


def edge_frequencies(active: DataFrame, n_frames: int | Column) -> DataFrame:
    """(e1, e2, share): share of frames with both edges active (seq_id, t, edge), e1 <= e2."""
    one, two = active.select("seq_id", "t", F.col("edge").alias("e1")), active.select("seq_id", "t", F.col("edge").alias("e2"))
    return one.join(two, ["seq_id", "t"]).filter("e1 <= e2").groupBy("e1", "e2").agg((F.count("*") / F.lit(n_frames)).alias("share"))


def allowed_transitions(states: DataFrame, with_self: bool = False) -> DataFrame:
    """(src, dst) of states (state_id, parts sorted array): the next one adds exactly one part.

    Each state looks up itself less one part, so states meet by key and not in all pairs.
    """
    less = states.select(F.col("state_id").alias("dst"), F.explode("parts").alias("gone"), F.col("parts").alias("_p"))
    less = less.select("dst", F.array_except("_p", F.array("gone")).alias("key"))
    out = less.join(states.select(F.col("state_id").alias("src"), F.col("parts").alias("key")), "key").select("src", "dst")
    return out.unionByName(states.select(F.col("state_id").alias("src"), F.col("state_id").alias("dst"))) if with_self else out


def hamming_one(vectors: DataFrame) -> DataFrame:
    """(a, b, prob): label vectors (id, v) that differ in exactly one place, rows normalised; each emits one key a place."""
    keys = vectors.select("id", "v", F.posexplode("v").alias("pos", "x")).select("id", "pos", "x", F.transform("v", lambda y, i: F.when(i == F.col("pos"), F.lit(None).cast("int")).otherwise(y)).alias("key"))
    text = F.concat_ws(",", F.col("pos"), F.transform("key", lambda y: F.coalesce(y.cast("string"), F.lit("*"))))
    keyed = keys.select("id", "x", text.alias("k"))
    pairs = keyed.alias("l").join(keyed.alias("r"), "k").filter("l.x <> r.x").select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    return pairs.withColumn("prob", 1 / F.count("*").over(Window.partitionBy("a")))


def event_transitions(states: DataFrame) -> DataFrame:
    """(event, src, dst): the part that leads from one state to the next."""
    s = states.select("state_id", "parts")
    moves = allowed_transitions(states).join(s.select(F.col("state_id").alias("src"), F.col("parts").alias("_a")), "src").join(s.select(F.col("state_id").alias("dst"), F.col("parts").alias("_b")), "dst")
    return moves.select(F.array_except("_b", "_a")[0].alias("event"), "src", "dst")


def endpoint_support(states: DataFrame, goals: Column) -> DataFrame:
    """(state_id, can_start, can_end): the empty state starts, goal states end."""
    return states.select("state_id", (F.size("parts") == 0).alias("can_start"), goals.alias("can_end"))


def parse_transition_table(rules: DataFrame, key: str, normalize: bool = False) -> DataFrame:
    """(key, src, dst, value) from columns named ``from->to``; shares of the key on request."""
    names = [c for c in rules.columns if "->" in c]
    long = rules.unpivot([key], names, "move", "value").select(key, F.split("move", "->")[0].cast("int").alias("src"), F.split("move", "->")[1].cast("int").alias("dst"), "value")
    return long.withColumn("value", F.col("value") / F.sum("value").over(Window.partitionBy(key))) if normalize else long


def expand_event_rules(rules: DataFrame, categories: DataFrame) -> DataFrame:
    """(event, mode, slot, part): an AND of ORs (event, parts ARRAY<ARRAY<STRING>>, ``*name`` a category) as an OR of ANDs."""
    slots = rules.select("event", F.posexplode("parts").alias("slot", "options")).select("event", "slot", F.explode("options").alias("option"))
    members = slots.join(categories, F.col("option") == F.concat(F.lit("*"), F.col("category")), "left").select("event", "slot", F.coalesce("member", "option").alias("part"))
    lists = members.groupBy("event", "slot").agg(F.sort_array(F.collect_set("part")).alias("o")).groupBy("event").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "o"))), lambda x: x["o"]).alias("lists"))
    empty = F.array(F.array().cast("array<string>"))
    modes = F.aggregate("lists", empty, lambda acc, o: F.flatten(F.transform(acc, lambda m: F.transform(o, lambda x: F.concat(m, F.array(x))))))
    return lists.select("event", F.posexplode(modes).alias("mode", "m")).select("event", "mode", F.posexplode("m").alias("slot", "part"))


def state_connections(states: DataFrame) -> DataFrame:
    """(state_id, joint, connected): 1 where a state has a joint, 0 for the other joints of the vocabulary."""
    joints = states.select(F.explode("parts").alias("joint")).distinct()
    return beside(states.select("state_id", "parts"), joints).select("state_id", "joint", F.array_contains("parts", F.col("joint")).cast("int").alias("connected"))


def event_state_scores(modes: DataFrame, connections: DataFrame, moves: DataFrame) -> DataFrame:
    """(event, src, dst, s): log of the sum over an event's modes of the product over its joints of the chance that the joint moves as the states say.

    ``modes`` is (event, mode, joint), ``connections`` (state_id, joint, connected), ``moves`` (event, src, dst, value) on connection values. Pairs in which a joint cannot move so are left out.
    """
    c1 = connections.select(F.col("state_id").alias("src"), "joint", F.col("connected").alias("_c"))
    c2 = connections.select(F.col("state_id").alias("dst"), "joint", F.col("connected").alias("_n"))
    m = moves.filter("value > 0").select("event", F.col("src").alias("_c"), F.col("dst").alias("_n"), "value")
    need = modes.groupBy("event", "mode").agg(F.count("*").alias("_need"))
    tied = modes.join(c1, "joint").join(m, ["event", "_c"]).join(c2, ["joint", "_n"])
    per = tied.groupBy("event", "mode", "src", "dst").agg(F.sum(F.log("value")).alias("l"), F.count("*").alias("k")).join(need, ["event", "mode"]).filter("k = _need")
    top = F.max("l")
    return per.groupBy("event", "src", "dst").agg((F.log(F.sum(F.exp("l")))).alias("s"), top.alias("best"))


def pack_scores(starts: DataFrame, moves: DataFrame, ends: DataFrame, sentinel: int = -1) -> DataFrame:
    """(src, dst, s): start, transition and end scores in one table, the sentinel standing for outside."""
    a = starts.select(F.lit(sentinel).alias("src"), F.col("label").alias("dst"), "s")
    return a.unionByName(moves.select("src", "dst", "s")).unionByName(ends.select(F.col("label").alias("src"), F.lit(sentinel).alias("dst"), "s"))


def transitions_from_map(rules: DataFrame, column: str) -> DataFrame:
    """(src, dst): a map from state to its next states as rows."""
    return rules.select(F.explode(column).alias("src", "_next")).select("src", F.explode("_next").alias("dst"))


def fit_gaussians(points: DataFrame) -> DataFrame:
    """(cls, n, mx, my, vx, vy, cxy): means, population variances and covariance of each class, rows with missing parts left out."""
    seen = points.filter("x is not null and y is not null")
    return seen.groupBy("cls").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("cxy"))


def trim_and_refit(points: DataFrame, ratio: float = 0.05, few: int = 10_000) -> DataFrame:
    """Gaussians refitted without the lowest share of each class by score.

    A point is kept if the share of the class's other points that score less reaches ``ratio``, so ties are kept or dropped
    together and a class of one point is dropped unless ``ratio`` is 0. Missing scores rank lowest. The score that bounds the
    dropped ones is found by exact selection; no class is sorted.
    """
    scored = points.withColumn("score", F.col("score").cast("double"))
    sizes = scored.groupBy("cls").agg(F.count("*").alias("_n"), F.count_if(F.col("score").isNull()).alias("_none"))
    share = lambda m: F.when(F.col("_n") > 1, m / (F.col("_n") - 1)).otherwise(0.0)
    near = F.floor((F.col("_n") - 1) * F.lit(float(ratio)))
    # the least count of lower points that reaches the ratio, as the division decides it
    least = F.array_min(F.filter(F.sequence(F.greatest(near - 1, F.lit(0)), near + 2), lambda m: share(m) >= ratio))
    cut = stored(sizes.select("cls", "_none", F.coalesce(least, F.col("_n")).alias("_m")))
    last = cut.filter("_m > _none").select("cls", (F.col("_m") - F.col("_none") - 1).alias("rank"))
    bound = order_statistics(scored, last, "score", "cls", few=few).select("cls", F.coalesce("score", F.lit(float("nan"))).alias("_cut"))
    kept = scored.join(cut, "cls").join(bound, "cls", "left")
    above = F.when(F.col("_m") == 0, True).when(F.col("score").isNull(), False).when(F.col("_cut").isNull(), True).otherwise(F.col("score") > F.col("_cut"))
    return fit_gaussians(kept.filter(above))


def duration_gaussians(segments: DataFrame) -> DataFrame:
    """(label, mean, std, longest) of segment durations."""
    dur = F.col("end") - F.col("start")
    return segments.groupBy("label").agg(F.avg(dur).alias("mean"), F.stddev_samp(dur).alias("std"), F.max(dur).alias("longest"))


def inlier_mean(errors: DataFrame, most: float = 2e4) -> DataFrame:
    """One row: the mean of the finite errors up to ``most``."""
    return errors.filter(F.col("error").isNotNull() & ~F.isnan("error") & (F.abs("error") <= most)).agg(F.avg("error").alias("scale"))


def fit_pair_rates(pairs: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(connected, rate): exponential rates of pair values on connected and other pairs (p1, p2)."""
    marked = pairs.join(adjacency.withColumn("_c", F.lit(True)), ["p1", "p2"], "left")
    return marked.groupBy(F.coalesce("_c", F.lit(False)).alias("connected")).agg((1 / F.avg("value")).alias("rate"))


def fit_bins(means: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(cls, bin): classes put in k bins by k-means of their mean places."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    points = VectorAssembler(inputCols=["mx", "my"], outputCol="features").transform(means)
    return KMeans(k=k, seed=seed).fit(points).transform(points).select("cls", F.col("prediction").alias("bin"))
