"""Packing of tokenised documents into fixed windows by non-negative least squares.

A document of L ids is cut into whole windows and one tail. The histogram of tail lengths has one
bin for each length below the window, whatever the corpus, so the plan is made on the driver from
that table alone: shallow combinations (one to three lengths that fill a window exactly) become the
columns of a non-negative least-squares problem whose unknowns are repeat counts; the solution is
rounded down, topped up where lengths are left, and the rest is packed greedily, largest first,
each pattern repeated as often as the histogram allows. Documents then find their place by length
and rank: ranks are counted in hashed slices and offset by slice totals, so one length that a
third of all documents share is not gathered anywhere.

All cuts lie at window boundaries of a document, so checksums are known when it is tokenised and
no ids are shuffled. A sequence is padded to the window, except where its length is a power of two.

Defined results: a null or empty text is one end id; a text of any length is read whole; repeated rows
and rows without an id are packed one by one, told apart by ``row_copy``; among equal lengths places
go by hash and id; an empty table gives no pieces; only the operator's own columns are returned,
whatever others ``docs`` has.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.llm.words import TO_LOWER
from seqloom.storage import stored


@dataclass(frozen=True)
class PackingParams:
    """``cached_words``: word encodings of a generation that a worker keeps. ``slices``: least hashed slices of one length; one for each ``slice_rows`` documents."""

    window: int = 2048
    end_id: int = 1
    iterations: int = 200
    cached_words: int = 120_000
    slices: int = 256
    slice_rows: int = 100_000


#: What the tokenizer takes apart in a word of ASCII characters and Latin-1 letters without an apostrophe: runs of letters, single digits, runs of marks.
_PIECES = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]|[!-&(-/:-@\[-`{-~]+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be printed, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [x for x in range(256) if x not in shown]
    return [chr(x) if x in shown else chr(256 + hidden.index(x)) for x in range(256)]


class WordEncoder(dict):
    """Encodes texts word by word; a dictionary from words to their ids as little-endian unsigned 32-bit numbers.

    The tokenizer lower-cases, splits at white space and between letters, digits and marks, and never
    looks across such a place, so equal words have equal ids and each is encoded once, plain ones
    piece by piece with the tokenizer's model alone. A text that holds one of the tokenizer's special
    tokens is given to it whole. At ``cached_words`` words a new generation begins, to which those
    move that are met again.
    """

    def __init__(self, path: str, cached_words: int) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # no single word is one
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.cached_words, self.before, self.letters = cached_words, {}, _byte_letters()

    def _encoded(self, word: bytes) -> bytes:
        if word.isalpha():
            text = word.decode()
        else:
            pieces = _PIECES.findall(word)
            if sum(map(len, pieces)) < len(word):
                return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()
            if len(pieces) > 1:
                return b"".join([self[x] for x in pieces])
            text = "".join([self.letters[c] for c in word.decode().lower().encode()])
        return array("I", [x.id for x in self.model.tokenize(text)]).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self._encoded(word)
        if len(self) >= self.cached_words:
            self.before = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        self.tokenizer.encode_special_tokens = False
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        self.tokenizer.encode_special_tokens = True
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        if any(x in text for x in self.special):
            return self._whole(text)
        return b"".join(map(self.__getitem__, text.encode().translate(TO_LOWER).split()))


@lru_cache(1)
def _encoder(path: str, cached_words: int) -> WordEncoder:
    """A worker's encoder: kept from task to task."""
    return WordEncoder(path, cached_words)


def tokenised(docs: DataFrame, tokenizer_path: str, p: PackingParams, text_col: str, id_col: str) -> DataFrame:
    """(id, n, crcs, tail): ids with the end id, the checksum of each whole window and of the tail, the tail's length."""
    step = 4 * p.window

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = _encoder(tokenizer_path, p.cached_words).encode
        end = np.array([p.end_id], "<u4").tobytes()
        for pdf in batches:
            for i in range(0, len(pdf), 512):
                x = pdf.iloc[i : i + 512]
                rows = []
                for text in x["text"]:
                    data = encode(text or "") + end
                    rows.append((len(data) // 4, [zlib.crc32(data[j : j + step]) for j in range(0, len(data), step)], len(data) % step // 4))
                out = pd.DataFrame(rows, columns=["n", "crcs", "tail"])
                out.insert(0, "id", x["id"].to_numpy())
                yield out

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, n long, crcs array<long>, tail long")


def combinations(present: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths (0: none) from ``present`` that fill ``window`` exactly, each once, ascending."""
    have = np.zeros(window + 1, bool)
    have[present] = True
    lengths = np.concatenate([[0], present])
    found = []
    for a in lengths:
        b = lengths[lengths >= a]
        c = window - a - b
        fits = (c >= b) & (c > 0)
        b, c = b[fits], c[fits]
        ok = have[c]
        found.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(found) if found else np.empty((0, 3), np.int64)


def repeat_counts(columns: np.ndarray, histogram: np.ndarray, iterations: int) -> np.ndarray:
    """Non-negative repeat counts whose use of each length comes nearest the histogram (accelerated projected gradient)."""
    if not len(columns):
        return np.zeros(0)
    size = len(histogram)
    flat = columns.ravel()
    real = (flat > 0).astype(float)

    def use(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(x, 3) * real, size)

    def back(y: np.ndarray) -> np.ndarray:
        return (y[columns] * (columns > 0)).sum(axis=1)

    probe = np.ones(len(columns))
    for _ in range(12):  # power iteration: the step is one over the largest eigenvalue
        probe = back(use(probe))
        scale = np.linalg.norm(probe)
        probe /= scale
    x = z = np.zeros(len(columns))
    t = 1.0
    for _ in range(iterations):
        new = np.maximum(0, z - back(use(z) - histogram) / (1.05 * scale))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: np.ndarray, window: int, iterations: int = 200) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence) and how often each is used; together they use the histogram up.

    ``histogram[l]`` is the number of tails of length l, 0 < l < window.
    """
    left = histogram.astype(np.int64).copy()
    made: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...], most: int) -> None:
        once = {n: lengths.count(n) for n in lengths}
        k = min(most, *(int(left[n]) // c for n, c in once.items()))
        if k > 0:
            made.append((lengths, k))
            for n, c in once.items():
                left[n] -= k * c

    columns = combinations(np.flatnonzero(left), window)
    x = repeat_counts(columns, left.astype(float), iterations)
    used = np.flatnonzero(x > 1e-6)
    used = used[np.argsort(-x[used], kind="stable")]
    shapes = [tuple(int(n) for n in columns[i] if n) for i in used]
    for shape, i in zip(shapes, used, strict=True):
        if x[i] >= 1:
            take(shape, int(x[i]))
    # what the rounding left: first the columns that hold the longest lengths, as these are hardest to place
    for shape in sorted(shapes, key=lambda s: (-s[-1], len(s))):
        take(shape, int(left[shape[-1]]))
    # greedy residuals: the longest length, then as long as fits, again and again
    lengths = list(np.flatnonzero(left))
    while lengths:
        while lengths and left[lengths[-1]] == 0:
            lengths.pop()
        if not lengths:
            break
        shape, room = [], window
        spare = {}
        k = len(lengths) - 1
        while k >= 0 and room > 0:
            k = min(k, int(np.searchsorted(lengths, room, side="right")) - 1)
            if k < 0:
                break
            n = int(lengths[k])
            if left[n] - spare.get(n, 0) > 0:
                spare[n] = spare.get(n, 0) + 1
                shape.append(n)
                room -= n
            else:
                k -= 1
        take(tuple(shape), int(left[shape[0]]))
        lengths = [n for n in lengths if left[n] > 0]
    return made


def _ranked(lengths: DataFrame, keys: list[str], slices: int) -> DataFrame:
    """Adds ``rank``: 0, 1, 2, ... among the rows with equal ``keys``, counted slice by slice."""
    cut = lengths.withColumn("slice", F.pmod(F.xxhash64("id", "copy"), F.lit(slices)))
    totals = cut.groupBy(*keys, "slice").agg(F.count("*").alias("in_slice"))
    before = F.coalesce(F.sum("in_slice").over(Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select(*keys, "slice", before.alias("before"))
    local = F.row_number().over(Window.partitionBy(*keys, "slice").orderBy("id", "copy")) - 1
    return cut.withColumn("local", local).join(offsets, [*keys, "slice"]).withColumn("rank", F.col("before") + F.col("local")).drop("slice", "local", "before")


def pack(docs: DataFrame, tokenizer_path: str, p: PackingParams = PackingParams(), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and row_copy (repeated rows of an id differ in it)."""
    tokens = tokenised(docs, tokenizer_path, p, text_col, id_col)
    tokens = stored(tokens.withColumn("copy", F.monotonically_increasing_id()))
    counts = {r["tail"]: r["k"] for r in tokens.filter("tail > 0").groupBy("tail").agg(F.count("*").alias("k")).collect()}
    histogram = np.zeros(p.window + 1, np.int64)
    for n, k in counts.items():
        histogram[n] = k
    patterns = plan(histogram, p.window, p.iterations)
    # one row for each length and pattern: ranks from lo on go to this pattern, `times` to a sequence
    used: dict[int, int] = {}
    rows, sequences = [], 0
    for shape, k in patterns:
        offset = 0
        for n in shape:
            lo = used.get(n, 0)
            rows.append((n, lo, lo + k, sequences, offset))
            used[n] = lo + k
            offset += n
        sequences += k
    table = pd.DataFrame(rows, columns=["n", "lo", "hi", "first", "offset"]).sort_values(["n", "lo"])
    bounds = {int(n): (g["lo"].to_numpy(), g["first"].to_numpy(), g["offset"].to_numpy()) for n, g in table.groupby("n")}

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, rank = pdf["tail"].to_numpy(), pdf["rank"].to_numpy()
            seq, off = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
            for m in np.unique(n):
                at = n == m
                lo, first, offset = bounds[int(m)]
                k = np.searchsorted(lo, rank[at], side="right") - 1
                seq[at], off[at] = first[k] + rank[at] - lo[k], offset[k]
            yield pd.DataFrame({"id": pdf["id"], "copy": pdf["copy"], "start": pdf["start"], "length": n, "ids_crc32": pdf["crc"], "doc_tokens": pdf["n"], "sequence_id": seq, "offset": off})

    w = p.window
    tails = tokens.filter("tail > 0").select("id", "copy", "n", "tail", (F.col("n") - F.col("tail")).alias("start"), F.element_at("crcs", -1).alias("crc"))
    kinds = "id long, copy long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    slices = max(p.slices, sum(counts.values()) // p.slice_rows)
    tail_pieces = _ranked(tails, ["tail"], slices).mapInPandas(placed, kinds)
    # whole windows: numbered after the planned sequences, by slice and then within it
    many = tokens.filter(f"n >= {w}").withColumn("slice", F.pmod(F.xxhash64("id", "copy"), F.lit(slices))).withColumn("whole", F.expr(f"n div {w}"))
    parts = F.pmod(F.xxhash64("copy"), F.lit(64))
    sums = many.withColumn("part", parts).groupBy("slice", "part").agg(F.sum("whole").alias("in_part"))
    before = F.coalesce(F.sum("in_part").over(Window.orderBy("slice", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sums.select("slice", "part", before.alias("base"))  # at most 64 rows a slice
    here = Window.partitionBy("slice", "part").orderBy("id", "copy").rowsBetween(Window.unboundedPreceding, -1)
    numbered = many.withColumn("part", parts).withColumn("local", F.coalesce(F.sum("whole").over(here), F.lit(0))).join(base, ["slice", "part"])
    windows = numbered.select("id", "copy", "n", "local", "base", F.posexplode(F.slice("crcs", F.lit(1), F.col("whole").cast("int"))).alias("i", "crc"))
    whole_pieces = windows.select(
        "id", "copy", (F.col("i").cast("long") * w).alias("start"), F.lit(w).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"),
        (F.lit(sequences) + F.col("base") + F.col("local") + F.col("i")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    out = tail_pieces.unionByName(whole_pieces)
    return out.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", F.col("copy").alias("row_copy"))
