"""Features of multi-device signals: (seq_id, device, t, value) rows, pairs by one equi join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions.tables import beside
from seqloom.storage import stored


def magnitude(x: Column, y: Column, z: Column) -> Column:
    """Length of a 3-vector."""
    return F.sqrt(x * x + y * y + z * z)


def device_is_resting(signal: DataFrame, threshold: float = 1.0) -> DataFrame:
    """(seq_id, device, resting): whether the sample deviation of a device stays below the threshold."""
    return signal.groupBy("seq_id", "device").agg((F.stddev_samp("value") < threshold).alias("resting"))


def device_is_resting_3d(signal: DataFrame, threshold: float = 1.0) -> DataFrame:
    """The same for three axes: the root of the covariance determinant."""
    c = {a + b: F.covar_samp(a, b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")}
    det = c["xx"] * (c["yy"] * c["zz"] - c["yz"] * c["yz"]) - c["xy"] * (c["xy"] * c["zz"] - c["yz"] * c["xz"]) + c["xz"] * (c["xy"] * c["yz"] - c["yy"] * c["xz"])
    return signal.groupBy("seq_id", "device").agg((F.sqrt(F.greatest(det, F.lit(0.0))) < threshold).alias("resting"))


def center_signals(signal: DataFrame, resting: DataFrame) -> DataFrame:
    """Signals less the mean of the active devices at the same index; null where all rest."""
    at = Window.partitionBy("seq_id", "t")
    joined = signal.join(resting, ["seq_id", "device"])
    return joined.withColumn("value", F.col("value") - F.avg(F.when(~F.col("resting"), F.col("value"))).over(at)).drop("resting")


def device_pairs(signal: DataFrame) -> DataFrame:
    """(seq_id, t, d1, d2, a, b) for devices d1 > d2 at the same index."""
    one = signal.select("seq_id", "t", F.col("device").alias("d1"), F.col("value").alias("a"))
    two = signal.select("seq_id", "t", F.col("device").alias("d2"), F.col("value").alias("b"))
    return one.join(two, ["seq_id", "t"]).filter("d1 > d2")


def pair_diff(pairs: DataFrame) -> DataFrame:
    """Adds (100 - |a - b|) * (a / 200) * (b / 200)."""
    return pairs.withColumn("diff", (100 - F.abs(F.col("a") - F.col("b"))) * (F.col("a") / 200) * (F.col("b") / 200))


def pair_products(pairs: DataFrame) -> DataFrame:
    """Adds the product of the pair's signals."""
    return pairs.withColumn("product", F.col("a") * F.col("b"))


def pair_features(pairs: DataFrame) -> DataFrame:
    """Adds the difference of the pair's signals beside both."""
    return pairs.withColumn("difference", F.col("a") - F.col("b"))


def component_residual(signal: DataFrame, components: DataFrame) -> DataFrame:
    """Signals less the mean of the other devices of their component (seq_id, device, component); of a single one less 0."""
    at = Window.partitionBy("seq_id", "t", "component")
    n, total = F.count("*").over(at), F.sum("value").over(at)
    others = F.when(n > 1, (total - F.col("value")) / (n - 1)).otherwise(0.0)
    return signal.join(components, ["seq_id", "device"]).withColumn("residual", F.col("value") - others)


def remove_stationary_bias(signal: DataFrame, gyro: Column, threshold: float = 1.5) -> DataFrame:
    """Signals less their mean over the stationary samples, those with gyro below the threshold."""
    bias = F.avg(F.when(gyro < threshold, F.col("value"))).over(Window.partitionBy("seq_id", "device"))
    return signal.withColumn("value", F.col("value") - F.coalesce(bias, F.lit(0.0)))


def gyro_angle(signal: DataFrame, rate: str, seconds: str) -> DataFrame:
    """Adds the running integral of an angular rate over time."""
    order = Window.partitionBy("seq_id", "device").orderBy("t")
    dt = F.coalesce(F.col(seconds) - F.lag(seconds).over(order), F.lit(0.0))
    return signal.withColumn("_step", F.col(rate) * dt).withColumn("angle", F.sum("_step").over(order)).drop("_step")


def orientation_track(signal: DataFrame, gravity: float = 9.81, still: float = 0.005, block: int = 256) -> DataFrame:
    """(seq_id, device, t, qw, qx, qy, qz, vx, vy, vz, px, py, pz) from gyro and accelerometer streams, a device a group.

    The quaternion integrates the angular rate; acceleration turned to the world frame less gravity
    is integrated twice; where acceleration changes by less than ``still`` the velocity is set to 0.

    Products of quaternions are associative: a stream is cut into blocks of ``block`` samples, each is multiplied up on its
    own, the blocks' products are multiplied up along the device, and every sample takes its block's start times its own
    product so far. Velocity is a running sum since the last reset, position a running sum of it. A sample without one of its
    rates or its time has no orientation, nor has what follows it on that device; a missing acceleration leaves the velocity of its
    own sample's step out.
    """
    of = ["seq_id", "device"]
    order = Window.partitionBy(*of).orderBy("t")
    dt = F.when(F.row_number().over(order) == 1, F.lit(0.0)).otherwise(F.col("s") - F.lag("s").over(order))
    jump = F.greatest(*[F.abs(F.col(c) - F.lag(c).over(order)) for c in ("ax", "ay", "az")])
    read = signal.withColumns({"_dt": dt, "_reset": F.coalesce(jump < still, F.lit(False)), "_b": F.floor((F.row_number().over(order) - 1) / block)})
    x, y, z = (0.5 * F.col("_dt") * F.col(c) for c in ("gx", "gy", "gz"))
    size = F.sqrt(1 + x * x + y * y + z * z)
    turn = F.struct((1 / size).alias("w"), (x / size).alias("x"), (y / size).alias("y"), (z / size).alias("z"))
    samples = read.select(*of, "_b", F.struct("t", "_dt", "_reset", "ax", "ay", "az", turn.alias("turn")).alias("r"))
    blocks = samples.groupBy(*of, "_b").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    whole = F.array(F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))).cast("array<struct<w:double,x:double,y:double,z:double>>")
    # each array begins with the unit quaternion and has one more element than its samples
    scanned = stored(blocks.withColumn("_q", F.aggregate(F.transform("rows", lambda r: r["turn"]), whole, lambda acc, q: F.concat(acc, F.array(_multiplied(F.element_at(acc, -1), q))))))
    lasts = scanned.select(*of, "_b", F.element_at("_q", -1).alias("q"))
    along = lasts.groupBy(*of).agg(F.transform(F.array_sort(F.collect_list(F.struct("_b", "q"))), lambda r: r["q"]).alias("_all"))
    starts = along.select(*of, F.posexplode(F.aggregate("_all", whole, lambda acc, q: F.concat(acc, F.array(_multiplied(F.element_at(acc, -1), q))))).alias("_b", "_start"))
    tied = scanned.join(starts.withColumn("_b", F.col("_b").cast("long")), [*of, "_b"])
    own = F.inline(F.arrays_zip(F.col("rows").alias("r"), F.slice("_q", F.lit(2), F.size("rows")).alias("q"))).alias("r", "q")
    flat = tied.select(*of, "_start", own).select(*of, "r.*", _multiplied(F.col("_start"), F.col("q")).alias("q"))
    a, u = [F.col(c) for c in ("ax", "ay", "az")], [F.col("q." + c) for c in "xyz"]
    cross = lambda m, n: [m[1] * n[2] - m[2] * n[1], m[2] * n[0] - m[0] * n[2], m[0] * n[1] - m[1] * n[0]]
    inner = [c + F.col("q.w") * b for c, b in zip(cross(u, a), a, strict=True)]
    world = [b + 2 * c - down for b, c, down in zip(a, cross(u, inner), (0.0, 0.0, gravity), strict=True)]
    moved = flat.select("*", *[F.when(F.col("_reset"), 0.0).otherwise(w * F.col("_dt")).alias("_s" + c) for w, c in zip(world, "xyz", strict=True)])
    since = Window.partitionBy(*of, "_seg").orderBy("t")
    fast = moved.withColumn("_seg", F.count_if("_reset").over(order)).withColumns({"v" + c: F.sum("_s" + c).over(since) for c in "xyz"})
    placed = fast.withColumns({"p" + c: F.sum(F.col("v" + c) * F.col("_dt")).over(order) for c in "xyz"})
    return placed.select(*of, "t", *[F.col("q." + c).alias("q" + c) for c in "wxyz"], *["v" + c for c in "xyz"], *["p" + c for c in "xyz"])


def _multiplied(a: Column, b: Column) -> Column:
    """The product of two unit quaternions (w, x, y, z), brought back to length one."""
    raw = F.struct(
        (a["w"] * b["w"] - a["x"] * b["x"] - a["y"] * b["y"] - a["z"] * b["z"]).alias("w"), (a["w"] * b["x"] + a["x"] * b["w"] + a["y"] * b["z"] - a["z"] * b["y"]).alias("x"),
        (a["w"] * b["y"] - a["x"] * b["z"] + a["y"] * b["w"] + a["z"] * b["x"]).alias("y"), (a["w"] * b["z"] + a["x"] * b["y"] - a["y"] * b["x"] + a["z"] * b["w"]).alias("z"),
    )
    # bound to a name once, by a list of one
    return F.transform(F.array(raw), lambda q: F.transform(F.array(F.sqrt(q["w"] * q["w"] + q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"])), lambda n: F.struct(*[(q[c] / n).alias(c) for c in "wxyz"]))[0])[0]


def pair_distance(positions: DataFrame) -> DataFrame:
    """(seq_id, t, p1, p2, distance) for parts p1 > p2; null where a position is missing."""
    one = positions.select("seq_id", "t", F.col("part").alias("p1"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("z").alias("z1"))
    two = positions.select("seq_id", "t", F.col("part").alias("p2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2"))
    gap = magnitude(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2"), F.col("z1") - F.col("z2"))
    return one.join(two, ["seq_id", "t"]).filter("p1 > p2").select("seq_id", "t", "p1", "p2", gap.alias("distance"))


def feasible_pairs(holes: DataFrame) -> DataFrame:
    """(hole1, hole2) with hole1 > hole2 on different parts; names are part_hole_number. Joined on the vocabulary, not on frames."""
    part = F.split("hole", "_hole_")[0]
    one = holes.select(F.col("hole").alias("hole1"), part.alias("part1"))
    two = holes.select(F.col("hole").alias("hole2"), part.alias("part2"))
    return beside(one, two).filter("hole1 > hole2 and part1 <> part2").select("hole1", "hole2")


def average_pose(poses: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, x, y, z, qx, qy, qz, qw): mean position, and the normalised mean quaternion once all signs agree with the first marker."""
    q = ["qx", "qy", "qz", "qw"]
    first = Window.partitionBy(*keys).orderBy(order)
    lead = {c: F.first(c).over(first) for c in q}
    dot = sum((F.col(c) * lead[c] for c in q), F.lit(0.0))
    turned = poses.withColumn("_s", F.when(dot < 0, -1.0).otherwise(1.0))
    mean = turned.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("x", "y", "z")], *[F.avg(F.col("_s") * F.col(c)).alias(c) for c in q])
    size = F.sqrt(sum((F.col(c) * F.col(c) for c in q), F.lit(0.0)))
    return mean.select(*keys, "x", "y", "z", *[(F.col(c) / size).alias(c) for c in q])


def quaternion_product(a: str, b: str) -> dict[str, Column]:
    """Columns {a}x, ... times {b}x, ... as qx, qy, qz, qw."""
    c = lambda p, k: F.col(p + k)
    return {
        "qw": c(a, "w") * c(b, "w") - c(a, "x") * c(b, "x") - c(a, "y") * c(b, "y") - c(a, "z") * c(b, "z"),
        "qx": c(a, "w") * c(b, "x") + c(a, "x") * c(b, "w") + c(a, "y") * c(b, "z") - c(a, "z") * c(b, "y"),
        "qy": c(a, "w") * c(b, "y") - c(a, "x") * c(b, "z") + c(a, "y") * c(b, "w") + c(a, "z") * c(b, "x"),
        "qz": c(a, "w") * c(b, "z") + c(a, "x") * c(b, "y") - c(a, "y") * c(b, "x") + c(a, "z") * c(b, "w"),
    }


def child_poses(poses: DataFrame, joints: DataFrame) -> DataFrame:
    """Poses of child parts: the parent's pose times the fixed transform of each joint (parent, child, jx, jy, jz, jqx, jqy, jqz, jqw)."""
    tied = poses.join(joints, poses["part"] == joints["parent"])
    q, v = ["qx", "qy", "qz"], ["jx", "jy", "jz"]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    u, w = [F.col(c) for c in q], [F.col(c) for c in v]
    inner = [c + F.col("qw") * x for c, x in zip(cross(u, w), w, strict=True)]
    turned = [x + 2 * c for x, c in zip(w, cross(u, inner), strict=True)]
    place = [(F.col(p) + t).alias(p) for p, t in zip(("x", "y", "z"), turned, strict=True)]
    return tied.select("seq_id", "t", F.col("child").alias("part"), *place, *[x.alias(k) for k, x in quaternion_product("q", "jq").items()])


def check_camera_frames(readings: DataFrame) -> DataFrame:
    """(seq_id, part, t) where the cameras of a part disagree on the frame index."""
    return readings.groupBy("seq_id", "part", "t").agg(F.count_distinct("frame").alias("n")).filter("n > 1").select("seq_id", "part", "t")


def reaching_hand(hands: DataFrame, threshold: float) -> DataFrame:
    """Adds hx, hy of the hand that reaches (hand 1 first) and ``missing``; columns x1, y1, x2, y2 are null where unseen."""
    one, two = F.col("y1") > threshold, F.col("y2") > threshold
    pick = lambda a: F.when(one, F.col(a + "1")).when(two, F.col(a + "2"))
    return hands.withColumn("hx", pick("x")).withColumn("hy", pick("y")).withColumn("missing", F.col("x1").isNull() | F.col("x2").isNull())


def center_with_flag(frames: DataFrame, value: str) -> DataFrame:
    """Adds ``centered`` (less the mean of the sequence, missing as 0) and ``is_missing``."""
    centered = F.col(value) - F.avg(value).over(Window.partitionBy("seq_id"))
    return frames.withColumn("centered", F.coalesce(centered, F.lit(0.0))).withColumn("is_missing", F.col(value).isNull().cast("int"))


def impute_mean(frames: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values as the mean over all listed columns of the sequence."""
    every = Window.partitionBy("seq_id")
    total = sum((F.coalesce(F.sum(c).over(every), F.lit(0.0)) for c in columns), F.lit(0.0))
    n = sum((F.count(c).over(every) for c in columns), F.lit(0))
    out = frames.withColumn("_m", F.when(n > 0, total / n))
    return out.select(*[F.coalesce(c, "_m").alias(c) if c in columns else F.col(c) for c in frames.columns])


def track_pairs(hands: DataFrame) -> DataFrame:
    """Two detections a frame kept apart through time: swapped where that shortens the way from the frame before.

    The swap between neighbours does not depend on earlier swaps, so its running parity is enough.
    Frames with missing detections go through ``track_pairs_with_gaps``.
    """
    order = Window.partitionBy("seq_id").orderBy("t")
    p = {c: F.lag(c).over(order) for c in ("x1", "y1", "x2", "y2")}
    gap = lambda a, b: F.sqrt(F.pow(F.col("x" + a) - p["x" + b], 2) + F.pow(F.col("y" + a) - p["y" + b], 2))
    flip = F.when(gap("1", "2") + gap("2", "1") < gap("1", "1") + gap("2", "2"), 1).otherwise(0)
    odd = F.sum("_f").over(order) % 2 == 1
    out = hands.withColumn("_f", flip).withColumn("_o", odd)
    swap = lambda a, b: F.when(F.col("_o"), F.col(b)).otherwise(F.col(a)).alias(a)
    return out.select("seq_id", "t", swap("x1", "x2"), swap("y1", "y2"), swap("x2", "x1"), swap("y2", "y1"))


def track_pairs_with_gaps(hands: DataFrame, block: int = 256) -> DataFrame:
    """The same with missing detections: each is assigned to the nearer last seen place, and places are carried forward.

    A detection without an x or a y (null or NaN) is missing, and costs nothing in either place. A frame that sees both leaves
    only two possibilities, kept or swapped. So each stretch from one such frame up to the next is folded on its own, once
    for either start; what a stretch makes of its start is one of four functions (kept, swapped, always kept, always swapped),
    and the functions of the stretches before it compose by a running count of swaps since the last constant one.
    """
    order = Window.partitionBy("seq_id").orderBy("t")
    real = lambda c: F.when(~F.isnan(c), F.col(c))
    seen = lambda i: F.when(real("x" + i).isNotNull() & real("y" + i).isNotNull(), F.struct(F.col("x" + i).alias("x"), F.col("y" + i).alias("y")))
    frames = hands.select("seq_id", "t", seen("1").alias("a"), seen("2").alias("b"))
    stretch = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).over(order)
    rows = frames.withColumn("_g", stretch).groupBy("seq_id", "_g").agg(F.array_sort(F.collect_list(F.struct("t", "a", "b"))).alias("rows"))
    place = "struct<x:double,y:double>"
    both = f"struct<p:{place},q:{place}>"
    apart = lambda u, v: F.coalesce(F.sqrt((u["x"] - v["x"]) * (u["x"] - v["x"]) + (u["y"] - v["y"]) * (u["y"] - v["y"])), F.lit(0.0))
    turns = lambda r, at: apart(r["a"], at["q"]) + apart(r["b"], at["p"]) < apart(r["a"], at["p"]) + apart(r["b"], at["q"])
    pair = lambda p, q: F.struct(p.alias("p"), q.alias("q")).cast(both)

    def moved(acc: Column, r: Column) -> Column:
        swap = turns(r, acc["at"])
        p = F.coalesce(F.when(swap, r["b"]).otherwise(r["a"]), acc["at"]["p"])
        q = F.coalesce(F.when(swap, r["a"]).otherwise(r["b"]), acc["at"]["q"])
        return F.struct(pair(p, q).alias("at"), F.concat(acc["way"], F.array(pair(p, q))).alias("way"))

    def walked(acc: Column, few: Column) -> Column:
        block = F.aggregate(few, F.struct(acc["at"].alias("at"), F.array().cast(f"array<{both}>").alias("way")), moved)
        return F.struct(block["at"].alias("at"), F.concat(acc["ways"], F.array(block["way"])).alias("ways"))

    # the way is laid down in blocks, so that a long stretch is not copied for each of its frames
    first = F.get("rows", F.lit(0))
    started = F.col("_g") > 0
    rest = F.when(started, F.slice("rows", 2, F.size("rows"))).otherwise(F.col("rows"))
    starts = F.when(F.size(rest) > 0, F.sequence(F.lit(1), F.greatest(F.size(rest), F.lit(1)), F.lit(block))).otherwise(F.array().cast("array<int>"))
    folded = lambda p, q: F.aggregate("few", F.struct(pair(p, q).alias("at"), F.array().cast(f"array<array<{both}>>").alias("ways")), walked)
    kept, turned = (F.when(started, first["a"]), F.when(started, first["b"])), (F.when(started, first["b"]), F.when(started, first["a"]))
    cut = rows.withColumn("_rest", rest).withColumn("few", F.transform(starts, lambda i: F.slice("_rest", i, F.lit(block))))
    folds = cut.select("seq_id", "_g", F.transform("rows", lambda r: r["t"]).alias("ts"), first.alias("first"), pair(*kept).alias("_at0"), pair(*turned).alias("_at1"), folded(*kept).alias("_f0"), folded(*turned).alias("_f1"))
    along = Window.partitionBy("seq_id").orderBy("_g")
    after = lambda f: F.coalesce(F.col("_g") > 0, F.lit(False)) & turns(F.col("first"), F.lag(f + ".at").over(along))
    maps = folds.withColumns({"_m0": after("_f0"), "_m1": after("_f1")})
    constant = F.col("_m0") == F.col("_m1")
    swaps = maps.withColumn("_n", F.count_if(F.col("_m0") & ~F.col("_m1")).over(along))
    since = F.last(F.when(constant, F.struct(F.col("_m0").cast("long").alias("m"), "_n")), ignorenulls=True).over(along)
    chosen = swaps.withColumn("_c", since).withColumn("_o", (F.col("_c.m") + F.col("_n") - F.col("_c._n")) % 2 == 1)
    pick = lambda name: F.when(F.col("_o"), F.col(name + "1")).otherwise(F.col(name + "0"))
    head = F.when(F.col("_g") > 0, F.array(pick("_at"))).otherwise(F.array().cast(f"array<{both}>"))
    way = chosen.select("seq_id", F.inline(F.arrays_zip(F.col("ts").alias("t"), F.concat(head, F.flatten(pick("_f")["ways"])).alias("w"))).alias("t", "w"))
    return way.select("seq_id", "t", F.col("w.p.x").alias("x1"), F.col("w.p.y").alias("y1"), F.col("w.q.x").alias("x2"), F.col("w.q.y").alias("y2"))


def activity_score(edges: DataFrame, action_class: int = 2) -> DataFrame:
    """(seq_id, t, score, active) from (seq_id, t, edge, score array, label): the largest action score of a frame less the sequence's mean."""
    best = edges.groupBy("seq_id", "t").agg(F.max(F.get("score", F.lit(action_class))).alias("score"), F.max(F.col("label") == action_class).alias("active"))
    return best.withColumn("score", F.col("score") - F.avg("score").over(Window.partitionBy("seq_id")))
