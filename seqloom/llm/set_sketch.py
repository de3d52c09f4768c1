"""Near-duplicate documents by SetSketch registers.

A document is its set of distinct word shingles. Register i is the smallest of an exponential
hash over the set, kept only as the exponent of a power of ``base`` and truncated to 16 bits:
``clamp(floor(1 - log_base(min h_i)), 0, q + 1)``. Registers of a union are the larger ones of its
parts, so chunks of a long text merge, and equal registers are about as likely as the sets are
alike, so bands of registers find candidates. For a candidate pair the counts of larger, smaller
and equal registers give the likelihood of each similarity; pairs whose estimate lies far below the
limit are dropped, all others are confirmed on their full sets.

Work is kept near linear in the rows of a bucket. Documents with the same set are one class. Every
bucket offers two members as pivots, the one most of whose shingles are common, which is the middle
of a group of near copies, and one by hash; each document is compared with its most promising pivots,
and confirmed links are contracted. What is left in buckets of several components is compared by its
rarest shingles: with the shingles of each document in one common order, rarest first, two documents
can only be similar enough if they share one of the first n - ceil(t * n) + 1. Documents of different
components are paired at each rare one of these, one that ``rare`` documents or fewer hold. A pair
that shares none of them shares no rare shingle at all, so its common shingles are at most the
smaller number of shingles that are not rare; only pairs for which that bound reaches the limit, and
which share one of those first shingles, are formed in the buckets, at the first bucket they share. That loses no link, and neither the common
text of a large group nor the edits of its members makes pairs that cannot be linked. Shingles are
counted, and pivots chosen, with sums and minima in each task before the shuffle, so a shingle or a
bucket that a third of the corpus shares is not gathered anywhere.

Defined results: documents without words or with a null text are empty, link with nothing and are
kept; a text of any length is read whole; repeated rows of one id are one document whose text is the
first in the order of set fingerprints; rows without an id are returned one by one, with component_id
null and kept, and link with nothing; ties go to the smallest id; an empty table gives an empty
result; ``near_duplicates`` returns its own columns only, ``keep_one_of_each`` every column and row
of the kept documents, whatever the columns' names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.components import connected_components
from seqloom.llm.words import hash_words, mix, shingles, words_of
from seqloom.storage import stored


@dataclass(frozen=True)
class SketchParams:
    """``threshold``: links need 100 * shared >= threshold * union. ``margin``: estimates below threshold less this are not confirmed.

    ``tries``: pivots that a document is compared with. ``broadcast_ids``: most document ids that are broadcast to pick texts; more are joined by shuffle.
    """

    shingle: int = 3
    threshold: int = 85
    bands: int = 20
    rows: int = 6
    base: float = 1.001
    rate: float = 20.0
    q: int = 65534
    margin: float = 0.20
    tries: int = 2
    rare: int = 16
    broadcast_ids: int = 500_000
    seed: int = 20

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def _coefficients(p: SketchParams) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    odd = rng.integers(0, 2**63, p.registers, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.integers(0, 2**63, p.registers, dtype=np.uint64)


def registers(items: np.ndarray, p: SketchParams) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes, as uint16. For an empty set all are 0."""
    if len(items) == 0:
        return np.zeros(p.registers, np.uint16)
    odd, add = _coefficients(p)
    low = np.full(p.registers, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(items), 2048):
        low = np.minimum(low, (items[i : i + 2048, None] * odd + add).min(axis=0))
    uniform = (low.astype(np.float64) + 0.5) / 2.0**64
    smallest = -np.log1p(-np.minimum(uniform, 1 - 1e-16)) / p.rate
    return np.clip(np.floor(1 - np.log(smallest) / np.log(p.base)), 0, p.q + 1).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, p: SketchParams) -> np.ndarray:
    """The most likely Jaccard similarity of each pair of register rows, given the set sizes."""
    up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - up - down
    u = na / np.maximum(na + nb, 1)
    v = 1 - u
    most = np.minimum(u / np.maximum(v, 1e-12), v / np.maximum(u, 1e-12))
    grid = np.linspace(0, 1, 129)[None, :] * np.minimum(most, 1.0)[:, None]

    def larger(x: np.ndarray) -> np.ndarray:
        x = np.clip(x, 1e-12, 1 - 1e-12)
        return -np.log1p(-x * (p.base - 1) / p.base) / np.log(p.base)

    pu, pv = larger(u[:, None] - v[:, None] * grid), larger(v[:, None] - u[:, None] * grid)
    like = up[:, None] * np.log(pu) + down[:, None] * np.log(pv) + same[:, None] * np.log(np.clip(1 - pu - pv, 1e-12, 1))
    return grid[np.arange(len(grid)), like.argmax(axis=1)]


def fingerprint(items: np.ndarray) -> str:
    """Size and 128 hash bits of a set."""
    with np.errstate(over="ignore"):
        one, two = int(mix(items).sum(dtype=np.uint64)), int(mix(items ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    return f"{len(items):x}-{one:016x}{two:016x}"


def _sketched(docs: DataFrame, p: SketchParams) -> DataFrame:
    """(id, lone, n, print, regs): set size, 128-bit fingerprint of the set, registers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = (shingles(hash_words(words_of(text)), p.shingle) for text in pdf["text"])
            rows = [(len(s), fingerprint(s), registers(s, p).tobytes()) for s in sets]
            out = pd.DataFrame(rows, columns=["n", "print", "regs"])
            out.insert(0, "lone", pdf["lone"].astype("Int64").to_numpy())
            out.insert(0, "id", pdf["id"].astype("Int64").to_numpy())
            yield out

    return docs.mapInPandas(run, "id long, lone long, n long, print string, regs binary")


def _keys(p: SketchParams) -> Column:
    """The buckets of a set's registers, one a band; no bucket is shared by two bands."""
    width = 2 * p.rows
    return F.transform(F.sequence(F.lit(0), F.lit(p.bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("regs"), i * width + 1, F.lit(width))))


def _estimated(pairs: DataFrame, reps: DataFrame, p: SketchParams) -> DataFrame:
    """(a, b, est) of the pairs whose estimate does not rule a link out."""
    left = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    right = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 4096):
                x = pdf.iloc[i : i + 4096]
                ra = np.frombuffer(b"".join(x["ra"]), np.uint16).reshape(len(x), -1)
                rb = np.frombuffer(b"".join(x["rb"]), np.uint16).reshape(len(x), -1)
                est = estimate(ra, rb, x["na"].to_numpy(float), x["nb"].to_numpy(float), p)
                keep = est >= p.threshold / 100 - p.margin
                yield pd.DataFrame({"a": x["a"].to_numpy()[keep], "b": x["b"].to_numpy()[keep], "est": est[keep]})

    return pairs.join(left, "a").join(right, "b").mapInPandas(run, "a long, b long, est double")


def _reachable(n1: str, o1: str, n2: str, o2: str, p: SketchParams) -> str:
    """SQL: whether two sets of these sizes can be similar enough if they share at most the smaller of o1 and o2 shingles."""
    return f"100 * least({o1}, {o2}) >= {p.threshold} * ({n1} + {n2} - least({o1}, {o2}))"


def _confirmed(pairs: DataFrame, sets: DataFrame, p: SketchParams) -> DataFrame:
    """(a, b) of the pairs that are linked, counted on their full sets."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").filter(100 * both >= p.threshold * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _full_sets(docs: DataFrame, wanted: DataFrame, p: SketchParams) -> DataFrame:
    """(id, items) for the wanted documents (id, print): the sorted hashes of the shingles; texts of an id with another print are passed over."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingles(hash_words(words_of(t)), p.shingle) for t in pdf["text"]]
            right = [fingerprint(s) == x for s, x in zip(sets, pdf["print"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"][right], "items": [s.view(np.int64) for s, ok in zip(sets, right, strict=True) if ok]})

    return docs.join(wanted, "id").select("id", "text", "print").mapInPandas(run, "id long, items array<long>")


def _rarest(sets: DataFrame, p: SketchParams) -> DataFrame:
    """(id, n, core, prefix): for each set how many of its shingles are not rare, and the (count, token) of which a similar set must share one.

    Counts are numbers of sets in ``sets``; shingles that no other set has are left out.
    """
    tokens = sets.select("id", F.size("items").alias("n"), F.explode("items").alias("token"))
    counts = stored(tokens.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1"))
    shared = tokens.join(counts, "token").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("k", "token"))).alias("shared"))
    # rarest first: the n - |shared| shingles of its own come before these
    length = F.expr(f"n - cast(ceil({p.threshold} * n / 100) as int) + 1 - (n - size(shared))")
    prefix = F.when(length > 0, F.slice("shared", F.lit(1), F.greatest(length, F.lit(1)))).otherwise(F.slice("shared", 1, 0))
    return shared.filter(f"100 * size(shared) >= {p.threshold} * n").select("id", "n", F.size(F.filter("shared", lambda x: x["k"] > p.rare)).alias("core"), prefix.alias("prefix"))


def _left_pairs(left: DataFrame, ranked: DataFrame, reps: DataFrame, p: SketchParams) -> DataFrame:
    """(a, b): the pairs of different components that may be linked, among documents (key, id, c) of buckets with several components."""
    docs = stored(ranked.join(left.select("id", "c").distinct(), "id"))
    rare = docs.select("id", "c", "n", F.explode(F.filter("prefix", lambda x: x["k"] <= p.rare)).alias("x")).select("id", "c", "n", F.col("x.token").alias("token"))
    twin = rare.select("token", F.col("id").alias("id2"), F.col("c").alias("c2"), F.col("n").alias("n2"))
    at_rare = rare.join(twin, "token").filter("c < c2").filter(_reachable("n", "n", "n2", "n2", p)).select(F.col("id").alias("a"), F.col("id2").alias("b"))
    cores = docs.filter(f"100 * core >= {p.threshold} * n").select("id", "c", "n", "core", F.transform("prefix", lambda x: x["token"]).alias("first"))
    cores = stored(cores.join(reps.select("id", _keys(p).alias("keys")), "id"))
    spots = cores.select("id", "c", F.explode("keys").alias("key"))
    mixed = stored(spots.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key"))
    spots = cores.select("id", "c", "n", "core", "first", "keys", F.posexplode("keys").alias("pos", "key")).join(mixed, "key")
    other = spots.select("key", F.col("id").alias("id2"), F.col("c").alias("c2"), F.col("n").alias("n2"), F.col("core").alias("o2"), F.col("first").alias("f2"), F.col("keys").alias("k2"))
    met = F.arrays_overlap(F.slice("keys", F.lit(1), F.col("pos")), F.slice("k2", F.lit(1), F.col("pos")))
    at_core = spots.join(other, "key").filter("c < c2").filter(_reachable("n", "core", "n2", "o2", p)).filter(~met & F.arrays_overlap("first", "f2")).select(F.col("id").alias("a"), F.col("id2").alias("b"))
    return at_rare.unionAll(at_core).distinct()


def near_duplicates(docs: DataFrame, p: SketchParams = SketchParams(), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links), kept, n_same (documents with the same set)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    lone = F.when(F.col("id").isNull(), F.monotonically_increasing_id())
    sketches = stored(_sketched(texts.withColumn("lone", lone), p).groupBy("id", "lone").agg(F.min(F.struct("print", "n", "regs")).alias("s"), F.count("*").alias("rows")).select("id", "lone", "s.*", "rows"))
    full = sketches.filter("n > 0 and id is not null")
    reps = stored(full.groupBy("print").agg(F.min("id").alias("id"), F.count("*").alias("n_same"), F.first("n").alias("n"), F.first("regs").alias("regs")))
    bands = reps.select("id", F.explode(_keys(p)).alias("key"))
    shared = stored(bands.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("key"))
    members = stored(bands.join(shared, "key"))
    wanted = stored(reps.select("id", "print").join(members.select("id").distinct(), "id"))
    few = wanted.count() <= p.broadcast_ids
    sets = _full_sets(texts, F.broadcast(wanted) if few else wanted, p)
    sets = stored(sets if sketches.filter("id is not null and rows > 1").isEmpty() else sets.dropDuplicates(["id"]))
    ranked = stored(_rarest(sets, p))
    placed = members.join(ranked.select("id", (F.col("core") / F.col("n")).alias("common")), "id")  # the others can be like nobody
    middle, other = F.max_by("id", F.struct("common", -F.col("id"))), F.min_by("id", F.xxhash64("id"))
    pivots = stored(placed.groupBy("key").agg(F.array_distinct(F.array(middle, other)).alias("pivots"), F.count("*").alias("rows")).filter("rows > 1").select("key", "pivots"))
    pairs = placed.select("key", F.col("id").alias("a")).join(pivots, "key").select("a", F.explode("pivots").alias("b")).filter("a <> b").distinct()
    best = _estimated(pairs, reps, p).groupBy("a").agg(F.sort_array(F.collect_list(F.struct("est", "b")), asc=False).alias("x"))
    best = best.select("a", F.explode(F.slice("x", 1, p.tries)).alias("x")).select("a", "x.b")
    component = stored(connected_components(_confirmed(best, sets, p)))
    placed = placed.select("key", "id").join(component, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    mixed = stored(placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key"))
    left = stored(placed.join(mixed, "key"))
    more = stored(_confirmed(_estimated(_left_pairs(left, ranked, reps, p), reps, p), sets, p))
    if not more.isEmpty():
        # links between components: these are contracted, not the documents
        of = lambda x: component.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
        links = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        joined = stored(connected_components(links)).select(F.col("node").alias("c"), F.col("component").alias("to"))
        ids = component.select("node", F.col("component").alias("c")).unionAll(joined.select(F.col("c").alias("node"), "c")).distinct()
        component = stored(ids.join(joined, "c", "left").groupBy("node").agg(F.min(F.coalesce("to", "c")).alias("component")))
    classes = reps.select("print", F.col("id").alias("rep"), "n_same").join(component, F.col("rep") == F.col("node"), "left").select("print", "n_same", F.coalesce("component", "rep").alias("component_id"))
    linked = sketches.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("print")).alias("print")).join(classes, "print", "left")
    component_id = F.coalesce("component_id", "id")
    return linked.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.coalesce(component_id == F.col("id"), F.lit(True)).alias("kept"), F.coalesce("n_same", F.lit(1).cast("long")).alias("n_same")
    )


def keep_one_of_each(docs: DataFrame, p: SketchParams = SketchParams(), id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its group; rows without an id, and rows that repeat a kept id, stay."""
    marks = near_duplicates(docs, p, id_col=id_col).filter("not kept").select(id_col)
    return docs.join(marks, id_col, "left_anti").select(*docs.columns)
