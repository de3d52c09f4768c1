"""Quality rules: word and line counts, and bands for the zstandard ratio of a text.

Repetitive text compresses too well and noise hardly at all, so a text is kept while its
compression ratio (compressed over raw bytes) lies in a band. The ratio depends on the length, so
each length class, a quarter of an octave of bytes, has its own limits. They are fitted to the
corpus: a histogram of the ratios of all texts, with at most ``CLASSES`` times ``BINS`` rows, gives
the median and the spread (median absolute deviation) of each class; both are smoothed by a running
median over five classes, so that one class that copies of a text fill can't set its limits alone,
and limits lie ``spreads`` spreads off the median. Where a class and its neighbours hold few texts,
the limits move towards wide ones.

A text is tested twice: as a whole and in fixed chunks, each chunk by the limits of its own length
(so also the shorter last one), where one long run of repeats shows that the rest of a long text
would hide.

Defined results: a null text counts as an empty one; an empty text has ratio null and fails on its
word count; a text of any length is read whole; repeated rows are judged one by one and equally; a
ratio at a limit is inside; an empty table has no fitted limits and no rows; ``quality_rules``
returns the id column as it is, nulls included, and its own columns only, whatever others ``docs``
has; ``apply_quality_rules`` keeps every column.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.words import hash_words, windows, words_of

SYMBOLS = b"#*$%&|<>"
WINDOW = 3
#: Length classes (four an octave, up to 2 ** 40 bytes) and bins of the ratio, 0 to 2.
CLASSES, BINS = 161, 800


@dataclass(frozen=True)
class BandParams:
    """How the bands are fitted and applied.

    ``spreads``: how far limits lie off the median. ``least_spread``: a spread is at least this.
    ``prior``: so many texts the wide limits, ``wide_low`` and ``wide_high``, count for in a class.
    A text fails once more than ``bad_share`` of its chunk bytes lie outside.
    """

    level: int = 3
    chunk_bytes: int = 1024
    spreads: float = 4.0
    least_spread: float = 0.004
    prior: float = 10.0
    wide_low: float = 0.2
    wide_high: float = 1.3
    bad_share: float = 0.25


@dataclass(frozen=True)
class Bands:
    """The lowest and highest ratio of each length class."""

    low: tuple[float, ...]
    high: tuple[float, ...]

    def holds(self, n_bytes: int, ratio: float) -> bool:
        c = length_class(n_bytes)
        return self.low[c] <= ratio <= self.high[c]


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_bytes long, whole_ratio double, chunk_low double, chunk_high double, reason string"
)


def length_class(n_bytes: int) -> int:
    """The quarter octave that a length lies in."""
    return min(CLASSES - 1, int(4 * np.log2(max(1, n_bytes))))


def repeated_words(hashes: np.ndarray) -> int:
    """Words that lie in a window of three words which the text holds twice or more."""
    w = windows(hashes, WINDOW)
    if len(w) < 2:
        return 0
    _, inverse, counts = np.unique(w, return_inverse=True, return_counts=True)
    hit = counts[inverse] > 1
    covered = np.zeros(len(hashes), bool)
    for j in range(WINDOW):
        covered[j : j + len(w)] |= hit
    return int(covered.sum())


def fitted_bands(histogram: np.ndarray, p: BandParams = BandParams()) -> Bands:
    """Bands from the counts[class, bin] of all texts."""
    centres = (np.arange(BINS) + 0.5) * 2 / BINS
    median, spread, size = np.zeros(CLASSES), np.zeros(CLASSES), histogram.sum(axis=1)
    half = lambda counts, at: at[np.searchsorted(np.cumsum(counts), counts.sum() / 2)]
    full = np.flatnonzero(size)
    for c in full:
        median[c] = half(histogram[c], centres)
        off = np.abs(centres - median[c])
        order = np.argsort(off, kind="stable")
        spread[c] = 1.4826 * half(histogram[c][order], off[order])
    low, high = np.full(CLASSES, p.wide_low), np.full(CLASSES, p.wide_high)
    for i, c in enumerate(full):
        near = full[max(0, i - 2) : i + 3]
        n, m, s = size[near].sum(), np.median(median[near]), max(p.least_spread, np.median(spread[near]))
        low[c] = (n * max(p.wide_low, m - p.spreads * s) + p.prior * p.wide_low) / (n + p.prior)
        high[c] = (n * min(p.wide_high, m + p.spreads * s) + p.prior * p.wide_high) / (n + p.prior)
    return Bands(tuple(low.tolist()), tuple(high.tolist()))


def fit_bands(docs: DataFrame, p: BandParams = BandParams(), text_col: str = "text") -> Bands:
    """Bands fitted to all texts of ``docs``; only counts by class and bin reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=p.level)
        counts: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                data = (text or "").encode("utf-8", "surrogatepass")
                if data:
                    counts[length_class(len(data)), min(BINS - 1, int(len(packer.compress(data)) / len(data) * BINS / 2))] += 1
        yield pd.DataFrame([(c, b, k) for (c, b), k in counts.items()], columns=["c", "b", "k"]).astype({"c": "int32", "b": "int32", "k": "int64"})

    counts = docs.select(F.col(text_col).alias("text")).mapInPandas(run, "c int, b int, k long").groupBy("c", "b").agg(F.sum("k").alias("k"))
    histogram = np.zeros((CLASSES, BINS))
    for r in counts.collect():  # at most CLASSES * BINS rows
        histogram[r["c"], r["b"]] = r["k"]
    return fitted_bands(histogram, p)


def judge(text: str | None, bands: Bands, p: BandParams, packer: zstandard.ZstdCompressor) -> tuple:
    """The row of ``SCHEMA`` for one text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    word_chars = len(text) - (len(data) - sum(map(len, words)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(hash_words(words))
    base_failed = n < 50 or 100 * repeats > 50 * n
    whole = low = high = None
    reason = "base" if base_failed else None
    if data:
        whole = len(packer.compress(data)) / len(data)
        chunks = [data[i : i + p.chunk_bytes] for i in range(0, len(data), p.chunk_bytes)] if len(data) > p.chunk_bytes else [data]
        ratios = [len(packer.compress(x)) / len(x) for x in chunks] if len(chunks) > 1 else [whole]
        low, high = min(ratios), max(ratios)
        if reason is None:
            bad = sum(len(x) for x, r in zip(chunks, ratios, strict=True) if not bands.holds(len(x), r))
            if not bands.holds(len(data), whole):
                reason = "whole"
            elif bad > p.bad_share * len(data):
                reason = "chunk"
    return (n, word_chars, symbols, dup_lines, repeats, base_failed, reason is None, len(data), whole, low, high, reason)


def quality_rules(docs: DataFrame, p: BandParams = BandParams(), text_col: str = "text", id_col: str = "doc_id", bands: Bands | None = None) -> DataFrame:
    """Counts and verdict for every row of ``docs``: ``id_col`` and the columns of ``SCHEMA``. ``bands`` are fitted to ``docs`` unless given."""
    fitted = bands or fit_bands(docs, p, text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=p.level)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for pdf in batches:
            out = pd.DataFrame([judge(t, fitted, p, packer) for t in pdf["text"]], columns=names)
            for c in ("whole_ratio", "chunk_low", "chunk_high"):
                out[c] = out[c].astype("Float64")
            out.insert(0, "id", pdf["id"].to_numpy())
            yield out

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, {SCHEMA}")
    return out.withColumnRenamed("id", id_col)


def apply_quality_rules(docs: DataFrame, p: BandParams = BandParams(), text_col: str = "text", bands: Bands | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns unchanged and in place."""
    fitted = bands or fit_bands(docs, p, text_col)

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        packer = zstandard.ZstdCompressor(level=p.level)
        return pd.Series([judge(t, fitted, p, packer)[6] for t in texts])

    return docs.filter(kept(F.col(text_col)))
