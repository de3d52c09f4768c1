"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard transform; its hash is the
axis it lies nearest to, with sign. Two such hashes name a bucket, and several tables of buckets
are kept. Every vector lies in one bucket a table and also looks into the next most likely ones
(multiprobe: the second axis of either hash). Vectors that meet in a bucket are compared by cosine
in double precision.

A pair that meets more than once is counted at its first meeting only, which can be told from the
two vectors' bucket codes, so pairs are never listed: a block of a bucket yields one row a vector,
its links and the smallest vector it is tied to there. Equal vectors are one class that counts as
many. Buckets above ``block_rows`` rows are compared block against block in separate groups, however
many rows they hold. Codes do not travel with the vectors: a task works them out again for those
that it found a link of.

Defined results: null vectors, zero vectors, empty ones and those with null or non-finite parts link
with nothing; vectors of different length are never compared; rows that repeat an id are one vector,
the first in byte order; rows without an id are returned one by one, with component_id null and kept,
and link with nothing; an empty table gives an empty result; only the operator's own columns are
returned, whatever others ``vectors`` has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.components import connected_components
from seqloom.storage import stored


@dataclass(frozen=True)
class PolytopeParams:
    """``tables``: tables for vectors of up to 64 parts; each doubling of the length adds two, which holds the recall. ``broadcast_keys``: most large buckets whose list is broadcast; more are joined by shuffle."""

    threshold: float = 0.9
    tables: int = 9
    probes: int = 4
    block_rows: int = 4096
    shard_rows: int = 20_000
    broadcast_keys: int = 100_000
    seed: int = 7


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row; rows have a power of two of parts."""
    n = x.shape[1]
    h = 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def bucket_codes(x: np.ndarray, p: PolytopeParams) -> np.ndarray:
    """uint32[rows, tables, probes] of the buckets each row looks into; the first probe is its own bucket."""
    n = max(2, 1 << int(x.shape[1] - 1).bit_length())
    tables = p.tables + 2 * max(0, n.bit_length() - 7)
    rng = np.random.default_rng([p.seed, n])
    signs = rng.choice(np.array([-1.0, 1.0]), (tables, 2, 3, n))
    wide = np.zeros((len(x), n))
    wide[:, : x.shape[1]] = x
    out = np.empty((len(x), tables, p.probes), np.uint32)
    rows = np.arange(len(x))
    for t in range(tables):
        best, next_ = [], []
        for j in range(2):
            y = wide
            for s in signs[t, j]:
                y = hadamard(y * s)
            size = np.abs(y)
            a = size.argmax(axis=1)
            best.append(2 * a + (y[rows, a] > 0))
            size[rows, a] = -1
            b = size.argmax(axis=1)
            next_.append(2 * b + (y[rows, b] > 0))
        m = 2 * n
        probes = [best[0] * m + best[1], best[0] * m + next_[1], next_[0] * m + best[1], next_[0] * m + next_[1]]
        out[:, t] = np.stack(probes[: p.probes], axis=1)
    return out


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """bool[pairs, tables]: whether either row looks into the other's bucket."""
    return (a == b[:, :, :1]).any(axis=2) | (b == a[:, :, :1]).any(axis=2)


def _first_here(table: int, q: np.ndarray, i: np.ndarray, ids_q: np.ndarray, ids_i: np.ndarray) -> np.ndarray:
    """Which of the pairs (row q looking into the bucket of row i) have not met before."""
    earlier = _meet(q[:, :table], i[:, :table]).any(axis=1)
    back = (i[:, table] == q[:, table, :1]).any(axis=1)  # i looks into q's bucket as well: count the pair from the smaller id
    return ~earlier & (~back | (ids_q < ids_i))


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(pdf: pd.DataFrame, p: PolytopeParams, dtype: str) -> pd.DataFrame:
    """(id, links, low): the links that the blocks in ``pdf`` add to a vector, the smallest id it is tied to there. Vectors are of one length."""
    pdf = pdf.sort_values(["tab", "code", "x", "y"], kind="stable")
    ids, many, table = (pdf[c].to_numpy() for c in ("id", "many", "tab"))
    asks, owns = pdf["asks"].to_numpy(bool), pdf["owns"].to_numpy(bool)
    vec = np.frombuffer(b"".join(pdf["vec"]), dtype).reshape(len(pdf), -1).astype(np.float64)
    vec /= np.linalg.norm(vec, axis=1, keepdims=True)
    block = np.stack([pdf[c].to_numpy() for c in ("tab", "code", "x", "y")])
    cuts = np.flatnonzero(np.r_[True, (block[:, 1:] != block[:, :-1]).any(axis=0), True])
    links = np.zeros(len(pdf), np.int64)
    found_q, found_i, waiting = [], [], 0
    tied: list[tuple[np.ndarray, np.ndarray]] = []

    def settle() -> None:
        """Count the waiting pairs that meet here for the first time, and remember what they tie together."""
        nonlocal waiting
        q, i = np.concatenate(found_q), np.concatenate(found_i)
        found_q.clear()
        found_i.clear()
        waiting = 0
        rows, at = np.unique(np.concatenate([q, i]), return_inverse=True)
        codes = np.concatenate([bucket_codes(vec[rows[k : k + 1000]], p) for k in range(0, len(rows), 1000)])
        a, b = at[: len(q)], at[len(q) :]
        for t in np.unique(table[q]):
            here = np.flatnonzero(table[q] == t)
            for k in range(0, len(here), 65536):
                part = here[k : k + 65536]
                new = part[_first_here(int(t), codes[a[part]], codes[b[part]], ids[q[part]], ids[i[part]])]
                np.add.at(links, q[new], many[i[new]])
                np.add.at(links, i[new], many[q[new]])
        distinct, node = np.unique(ids[rows], return_inverse=True)
        tied.append((ids[rows], distinct[_labels(len(distinct), node[a], node[b])[node]]))

    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        asking, owning = lo + np.flatnonzero(asks[lo:hi]), lo + np.flatnonzero(owns[lo:hi])
        if hi - lo < 2 or not len(asking) or not len(owning):
            continue
        for at in range(0, len(asking), 1024):
            rows = asking[at : at + 1024]
            q, i = np.nonzero(vec[rows] @ vec[owning].T >= p.threshold)
            q, i = rows[q], owning[i]
            other = ids[q] != ids[i]
            if other.any():
                found_q.append(q[other])
                found_i.append(i[other])
                waiting += int(other.sum())
                if waiting > 2_000_000:
                    settle()
    if waiting:
        settle()
    if not tied:
        return pd.DataFrame({"id": np.empty(0, np.int64), "links": np.empty(0, np.int64), "low": np.empty(0, np.int64)})
    counted = pd.DataFrame({"id": ids, "links": links, "low": ids}).query("links > 0")
    ties = pd.concat([pd.DataFrame({"id": x, "links": 0, "low": low}) for x, low in tied]).query("low < id").drop_duplicates()
    return pd.concat([counted.groupby(["id", "low"], as_index=False)["links"].sum(), ties])


def near_vectors(vectors: DataFrame, p: PolytopeParams = PolytopeParams(), vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept, n_same (vectors equal to it, itself included)."""
    wide = vectors.schema[vec_col].dataType.elementType.simpleString() != "float"
    dtype = "<f8" if wide else "<f4"
    kind = np.float64 if wide else np.float32

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for v in pdf["v"]:
                x = None if v is None else np.array([np.nan if y is None else y for y in v], kind)
                sound = x is not None and len(x) and np.isfinite(x).all() and np.any(x)
                out.append((x + 0).astype(dtype).tobytes() if sound else None)
            yield pd.DataFrame({"id": pdf["id"].astype("Int64"), "lone": pdf["lone"].astype("Int64"), "vec": out})

    lone = F.when(F.col("id").isNull(), F.monotonically_increasing_id())
    one = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).withColumn("lone", lone).mapInPandas(packed, "id long, lone long, vec binary")
    every = one.groupBy("id", "lone").agg(F.min("vec").alias("vec"))
    every = stored(every.select("id", F.when(F.col("id").isNotNull(), F.col("vec")).alias("vec")).withColumn("class", F.sha2("vec", 256)))
    classes = every.filter("vec is not null").groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("many"), F.first("vec").alias("vec"))
    classes = stored(classes)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for size, g in pdf.groupby(pdf["vec"].str.len()):
                for at in range(0, len(g), 1000):
                    x = g.iloc[at : at + 1000]
                    v = np.frombuffer(b"".join(x["vec"]), dtype).reshape(len(x), -1).astype(np.float64)
                    codes = bucket_codes(v / np.linalg.norm(v, axis=1, keepdims=True), p)
                    for t in range(codes.shape[1]):
                        for j in range(p.probes):
                            yield pd.DataFrame({"tab": t, "dim": int(size), "code": codes[:, t, j].astype(np.int64), "own": j == 0, "id": x["rep"].to_numpy(), "many": x["many"].to_numpy(), "vec": x["vec"].to_numpy()})

    entries = classes.select("rep", "many", "vec").mapInPandas(hashed, "tab int, dim int, code long, own boolean, id long, many long, vec binary")
    key = ["tab", "dim", "code"]
    # buckets with one member, or in which nobody lives, compare nothing
    in_bucket = stored(entries.groupBy(*key).agg(F.count("*").alias("rows"), F.max("own").alias("lived")).filter("rows > 1 and lived").select(*key, "rows"))
    large = in_bucket.filter(F.col("rows") > p.block_rows).select(*key, F.expr(f"cast(ceil(rows / {p.block_rows}) as int)").alias("cuts"))
    few = large.count() <= p.broadcast_keys
    cut = entries.join(F.broadcast(large) if few else large, key, "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    cut = cut.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
    across = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: F.struct(F.col("mine").alias("x"), j.alias("y")))
    down = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: F.struct(j.alias("x"), F.col("mine").alias("y")))
    spots = F.array_distinct(F.when(F.col("own"), F.concat(across, down)).otherwise(across))
    placed = cut.select(*key, "own", "id", "many", "vec", "mine", F.explode(spots).alias("spot"))
    total = in_bucket.agg(F.sum("rows")).first()[0] or 0
    shards = max(1, int(total // p.shard_rows))
    placed = placed.select(
        F.pmod(F.xxhash64(*key, "spot"), F.lit(shards)).alias("shard"), *key, F.col("spot.x").alias("x"), F.col("spot.y").alias("y"), "id", "many", "vec",
        (F.col("spot.x") == F.col("mine")).alias("asks"), (F.col("own") & (F.col("spot.y") == F.col("mine"))).alias("owns"),
    )

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([_compare(g, p, dtype) for _, g in pdf.groupby("dim")])

    found = stored(placed.groupBy("shard").applyInPandas(compared, "id long, links long, low long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    component = connected_components(found.filter("low < id").select(F.col("id").alias("a"), F.col("low").alias("b")))
    whole = classes.select("class", "rep", "many").join(links, F.col("rep") == F.col("id"), "left").drop("id").join(component, F.col("rep") == F.col("node"), "left")
    whole = whole.select("class", "many", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = every.select("id", "class").join(whole, "class", "left")
    component_id = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component_id.alias("component_id"), F.coalesce(component_id == F.col("id"), F.lit(True)).alias("kept"), F.coalesce("many", F.lit(1).cast("long")).alias("n_same"))
