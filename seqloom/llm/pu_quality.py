"""Quality classifier by positive-unlabelled learning.

Trusted good texts are the positives, all other web text is unlabelled; labels of bad texts are
never used. The class prior is estimated by the best bin: where a first classifier is surest, the
unlabelled sample holds at most the prior times as much mass as the positive one. The final model
minimises the non-negative unbiased risk, pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)), with the
logistic loss; when the inner part turns negative, the step goes the other way. The model is
logistic over binned text measures, fitted on the driver from a bounded sample
(``most_positives`` and ``most_unlabelled`` rows, chosen by hash of the id); every text is scored
where it lies.

Defined results: null and empty texts have all measures zero and get a score like any other; a text
of any length is read whole; a document labelled more than once is positive if any label says so;
without positives the score is 0.5; repeated rows and rows without an id (never held out) are scored
one by one and equally; ties of the sampling hash go to the smallest id; an empty table gives an empty
result; language, source and id are never read by a score; only the operator's own columns are
returned, whatever others ``docs`` has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.words import TO_LOWER

MEASURES = (
    "log_words", "word_length", "distinct_words", "symbols", "pipes", "upper", "digits", "exclaims", "stops",
    "line_words", "repeated_lines", "same_neighbour", "ratio", "long_words", "first_upper", "odd_bytes",
)


@dataclass(frozen=True)
class PuParams:
    """``most_positives``, ``most_unlabelled``: bounds of the sample that is fitted on the driver."""

    most_positives: int = 15_000
    most_unlabelled: int = 25_000
    bins: int = 12
    steps: int = 500
    rate: float = 0.05
    l2: float = 1e-4
    fold: int = 3
    held: int = 1


def measures(text: str | None, packer: zstandard.ZstdCompressor) -> list[float]:
    """The measures of one text, in the order of ``MEASURES``."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(MEASURES)
    size = len(data)
    without = lambda drop: size - len(data.translate(None, drop))
    lowered = data.translate(TO_LOWER)
    lines = [x.strip() for x in data.split(b"\n") if x.strip()]
    letters = sum(map(len, words))
    return [
        float(np.log1p(n)), letters / n, len(set(lowered.split())) / n, without(b"#*$%&<>") / n, data.count(b"|") / n,
        without(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / letters, without(b"0123456789") / letters, data.count(b"!") / n, without(b".,;:?") / n,
        float(np.log1p(n / max(1, len(lines)))), 1 - len(set(lines)) / max(1, len(lines)), sum(a == b for a, b in zip(words, words[1:])) / n,
        len(packer.compress(data)) / size, sum(len(w) > 20 for w in words) / n, sum(w[0] < 91 for w in words) / n, without(b"{}[]\\^~`=_/@") / n,
    ]


@dataclass
class PuModel:
    """Weights over binned measures."""

    edges: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([(x[:, [j]] > self.edges[j][None, :]).astype(float) for j in range(x.shape[1])], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.design(x) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _adam(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Best-bin estimate: the smallest ratio of unlabelled to positive mass above a score, with a margin for sampling."""
    cuts = np.quantile(positive, np.linspace(0.05, 0.95, 61))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    margin = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = int(np.argmin((u + margin) / np.maximum(p, 1e-9)))
    return float(np.clip(u[best] / p[best], 0.05, 0.99))


def pu_risk(w: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float, l2: float) -> tuple[float, np.ndarray]:
    """The non-negative unbiased risk of weights ``w`` with the logistic loss, and the step's direction.

    While what unlabelled rows lose as negatives, less the prior's share of positives among them, is
    negative, the direction is that of raising it again.
    """
    zp, zu = positive @ w, unlabelled @ w
    inner = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    value = prior * np.logaddexp(0, -zp).mean() + max(0.0, inner) + l2 * (w @ w) / 2
    good = -prior * (positive.T @ (1 - _sigmoid(zp))) / len(positive)
    bad = unlabelled.T @ _sigmoid(zu) / len(unlabelled) - prior * (positive.T @ _sigmoid(zp)) / len(positive)
    return value, (good + bad if inner >= 0 else -bad) + l2 * w


def fit(positive: np.ndarray, unlabelled: np.ndarray, p: PuParams = PuParams()) -> PuModel:
    """The model of smallest non-negative risk; rows are texts, columns measures."""
    both = np.concatenate([positive, unlabelled])
    edges = np.stack([np.quantile(both[:, j], np.linspace(0, 1, p.bins + 2)[1:-1]) for j in range(both.shape[1])])
    # the tail of each measure gets edges of its own: junk is rare, so plain quantiles would pass it over
    tails = np.stack([np.quantile(both[:, j], [0.01, 0.03, 0.95, 0.97, 0.99]) for j in range(both.shape[1])])
    edges = np.sort(np.concatenate([edges, tails, np.zeros((len(edges), 1))], axis=1), axis=1)
    model = PuModel(edges, np.zeros(edges.size), 0.0, 0.5)
    xp, xu = model.design(positive), model.design(unlabelled)
    xp, xu = np.c_[xp, np.ones(len(xp))], np.c_[xu, np.ones(len(xu))]

    def separate(w: np.ndarray) -> np.ndarray:  # positives against unlabelled, for the prior
        return -(xp[::2].T @ (1 - _sigmoid(xp[::2] @ w))) / len(xp[::2]) + xu[::2].T @ _sigmoid(xu[::2] @ w) / len(xu[::2]) + p.l2 * w

    first = _adam(separate, xp.shape[1], p.steps // 2, p.rate)
    prior = estimate_prior(xp[1::2] @ first, xu[1::2] @ first)

    w = _adam(lambda w: pu_risk(w, xp, xu, prior, p.l2)[1], xp.shape[1], p.steps, p.rate)
    return PuModel(edges, w[:-1], float(w[-1]), prior)


def _measured(docs: DataFrame, extra: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=1)
        for pdf in batches:
            yield pdf.drop(columns="text").assign(x=[measures(t, packer) for t in pdf["text"]])

    return docs.mapInPandas(run, f"{extra}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, p: PuParams = PuParams(), text_col: str = "text", id_col: str = "doc_id") -> PuModel | None:
    """Fit on the training fold: rows whose crc32 of the id as text, modulo ``fold``, is not ``held``. None without positives."""
    seen = F.coalesce(F.crc32(F.col("id").cast("string")) % p.fold != p.held, F.lit(False))
    ids = docs.select(F.col(id_col).cast("long").alias("id")).filter(seen)
    good = labels.filter("quality = 1").select(F.col(id_col).cast("long").alias("id")).filter(seen).distinct()
    draw = lambda df, most, s: df.orderBy(F.xxhash64("id", F.lit(s)), "id").limit(most)
    chosen = draw(good.join(ids.distinct(), "id", "left_semi"), p.most_positives, 1).withColumn("kind", F.lit(1)).unionAll(draw(ids.distinct(), p.most_unlabelled, 2).withColumn("kind", F.lit(0)))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = _measured(texts.join(F.broadcast(chosen), "id").select("kind", "text"), "kind int").toPandas()  # at most the two bounds
    x = np.array(rows["x"].to_list(), float).reshape(len(rows), len(MEASURES))
    kind = rows["kind"].to_numpy()
    if not (kind == 1).any() or not (kind == 0).any():
        return None
    return fit(x[kind == 1], x[kind == 0], p)


def score_quality(docs: DataFrame, model: PuModel | None, p: PuParams = PuParams(), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=1)
        for pdf in batches:
            x = np.array([measures(t, packer) for t in pdf["text"]], float).reshape(len(pdf), len(MEASURES))
            s = np.full(len(pdf), 0.5) if model is None else model.score(x)
            yield pd.DataFrame({"id": pdf["id"], "held_out": pdf["held"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % p.fold == p.held, F.lit(False))
    out = docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held"), F.col(text_col).alias("text")).mapInPandas(run, "id long, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("id", id_col)
