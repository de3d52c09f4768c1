"""A word language model as a weighted backoff automaton, counted and applied over the whole corpus.

States are the n-grams, shorter than ``order``, that the training texts hold; the empty one is a
state too. From state h an arc for word w stands for the n-gram hw and weighs
(c(hw) + m * P(w | h')) / (c(h) + m), h' being h without its oldest word; where there is no arc the
failure arc to h' is followed, which weighs m / (c(h) + m). m is ``scale`` * c(h) ** ``power``, with
values of its own for each order: about the number of different words that follow h, so frequent
states lean on their own counts and rare ones on shorter states, and the arcs of every state sum to
one. The empty state holds the discounted unigrams: (c(w) - d) / N, and d * V / N for all unknown
words as one class, d being n1 / (n1 + 2 * n2). A text is one left-to-right traversal: it starts in
the state of the start tokens, follows failure arcs until the state has an arc for the next word,
takes it, and adds up the logarithms of the weights.

The automaton is as large as the corpus, so no task ever holds it. Texts are cut into blocks. Each
block sends its distinct n-grams with its own training counts, hashed into shards; a shard adds
them up and answers every block with the total counts of just the n-grams the block asked for. From
these a block builds the part of the automaton that its texts can visit (``Automaton``: arrays of
arcs, failure arcs and their targets). The traffic is a few bytes for each distinct n-gram of a
block, so a word, line or document that fills a third of the corpus costs no more than any other.
Hashes of unigrams have 64 bits; those of longer n-grams as many as make two of them meet with a
probability of 2 ** -20 at most, since they are many and sent as sorted differences.

Defined results: a null or empty text is one end token; a text of any length is read whole; repeated
rows, rows that share an id and rows without one (never held out) are counted and scored one by one;
without training tokens every word is unknown and has probability one; an empty table gives an empty
result; only the operator's own columns are returned, whatever others ``docs`` has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.words import hash_words, mix, windows, words_of
from seqloom.storage import stored

START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass(frozen=True)
class LmParams:
    """``scale``, ``power``: strength of the lower order in the states of one word, two words and so on; the last values hold for longer ones.

    ``block_bytes``: text of one block. ``grams_a_shard``: n-grams that a shard adds up.
    """

    order: int = 3
    scale: tuple[float, ...] = (30.0, 10.0)
    power: tuple[float, ...] = (0.8, 0.3)
    block_bytes: int = 8_000_000
    grams_a_shard: int = 1_000_000
    fold: int = 7
    held: int = 2

    def strength(self, count: np.ndarray, words: int) -> np.ndarray:
        """m of states of so many words with these counts."""
        i = min(words, len(self.scale)) - 1
        return self.scale[i] * np.asarray(count, float) ** self.power[i]


def _shrunk(keys: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as compressed differences, one byte plane after the other."""
    planes = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _grown(data: bytes) -> np.ndarray:
    """What ``_shrunk`` was given."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _counts_to(counts: np.ndarray) -> bytes:
    """64-bit counts, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _counts_of(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def _blocks(docs: DataFrame, p: LmParams) -> DataFrame:
    """(block, n_bytes, ids, held, lengths, texts): consecutive rows of a partition, about ``block_bytes`` of text.

    The texts of a block are one compressed value, as executors hold rows of many blocks at once when they read, send and sort them; a worker unpacks one at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = TaskContext.get().partitionId() << 24
        ids, held, texts, size = [], [], [], 0

        def flush() -> pd.DataFrame:
            return pd.DataFrame({"block": [block], "n_bytes": [size], "ids": [ids], "held": [held], "lengths": [[len(t) for t in texts]], "texts": [zstandard.ZstdCompressor(level=3).compress("".join(texts).encode())]})

        for pdf in batches:
            for i, h, t in zip(pdf["id"], pdf["held"], pdf["text"], strict=True):
                ids.append(i)
                held.append(bool(h))
                texts.append(t)
                size += 3 * len(t) // 2 + 8
                if size >= p.block_bytes:
                    yield flush()
                    block, ids, held, texts, size = block + 1, [], [], [], 0
        if ids:
            yield flush()

    return docs.mapInPandas(run, "block long, n_bytes long, ids array<long>, held array<boolean>, lengths array<int>, texts binary")


def _texts(lengths: np.ndarray, packed: bytes) -> list[str]:
    """The texts of a block, from their lengths in characters."""
    whole = zstandard.ZstdDecompressor().decompress(packed).decode()
    ends = np.cumsum(lengths).tolist()
    return [whole[i:j] for i, j in zip([0, *ends], ends)]  # noqa: B905


#: A block is a row of some MB: Parquet is to look after every row whether a page and a row group are full, not after a hundred.
BLOCK_ROWS = {"parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1, "parquet.block.size": 16 << 20}


def _grams(texts: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For k = 1 .. order the k-grams ending at each token of the padded texts, and the text each token belongs to.

    A text is order - 1 (at least one) start tokens, its words and one end token. k-grams that would
    reach over the start of a text are 0.
    """
    pad = max(1, order - 1)
    parts, owner = [], []
    start, end = np.full(pad, START), np.array([END])
    for t in texts:
        parts += [start, hash_words(words_of(t)), end]
        owner.append(len(parts[-2]) + pad + 1)
    tokens = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    owner_of = np.repeat(np.arange(len(texts)), owner)
    out = []
    for k in range(1, order + 1):
        g = mix(tokens + np.uint64(k)) if k == 1 else np.concatenate([np.zeros(k - 1, np.uint64), windows(tokens, k)])
        if k > 1:
            over = np.zeros(len(tokens), bool)
            first = np.cumsum([0, *owner[:-1]]).astype(int)
            for j in range(k - 1):
                over[np.minimum(first + j, max(len(tokens) - 1, 0))] = True
            g = np.where(over, np.uint64(0), g)
        out.append(g)
    return out, owner_of


def _keyed(grams: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The n-grams as they are sent: unigrams whole, longer ones by their leading ``width`` bits."""
    return [grams[0], *[g >> np.uint64(64 - width) for g in grams[1:]]]


def _requests(blocks: DataFrame, bits: int, width: int, p: LmParams) -> DataFrame:
    """(k, shard, block, grams, counts): sorted distinct k-grams of a block and how often its training texts hold each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, lengths, texts, held in zip(pdf["block"], pdf["lengths"], pdf["texts"], pdf["held"], strict=True):
                grams, owner = _grams(_texts(lengths, texts), p.order)
                train = ~np.asarray(held, bool)[owner]
                for k, g in enumerate(_keyed(grams, width), 1):
                    keys, inverse = np.unique(g, return_inverse=True)
                    counts = np.bincount(inverse, train, len(keys)).astype(np.int64)
                    shard = (keys >> np.uint64((64 if k == 1 else width) - bits)).astype(np.int64)
                    at = np.flatnonzero(np.diff(shard, prepend=-1))
                    ends = np.append(at[1:], len(keys))
                    yield pd.DataFrame({"k": k, "shard": shard[at], "block": block, "grams": [_shrunk(keys[i:j]) for i, j in zip(at, ends, strict=True)], "counts": [_counts_to(counts[i:j]) for i, j in zip(at, ends, strict=True)]})

    return blocks.select("block", "held", "lengths", "texts").mapInPandas(run, "k int, shard long, block long, grams binary, counts binary")


def _totals(requests: DataFrame) -> DataFrame:
    """(k, shard, block, counts, v, n1, n2, n): total counts in the order asked for; unigram statistics in rows without a block."""
    start = int(mix(np.array([START + np.uint64(1)]))[0])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_grown(x) for x in pdf["grams"]]
        counts = np.concatenate([_counts_of(x) for x in pdf["counts"]])
        distinct, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, inverse, counts)
        ends = np.cumsum([len(x) for x in parts])
        out = pd.DataFrame({"k": pdf["k"], "shard": pdf["shard"], "block": pdf["block"].astype("Int64"), "counts": [_counts_to(x) for x in np.split(total[inverse], ends[:-1])]})
        for c in ("v", "n1", "n2", "n"):
            out[c] = pd.array([pd.NA] * len(out), "Int64")
        if pdf["k"].iloc[0] == 1:
            words = total[distinct != np.uint64(start)]
            row = {"k": 1, "shard": pdf["shard"].iloc[0], "block": pd.NA, "counts": None, "v": (words > 0).sum(), "n1": (words == 1).sum(), "n2": (words == 2).sum(), "n": words.sum()}
            out = pd.concat([out, pd.DataFrame([row]).astype({c: "Int64" for c in ("block", "v", "n1", "n2", "n")})], ignore_index=True)
        return out

    return requests.groupBy("k", "shard").applyInPandas(run, "k int, shard long, block long, counts binary, v long, n1 long, n2 long, n long")


@dataclass
class Automaton:
    """The states and arcs that the texts of a block can visit; entry k - 1 of each list is for k-grams.

    ``here[k - 1][i]``: which k-gram ends at token i. Of k-gram g: ``count``, how often training holds it;
    ``arc``, the log10 weight of the arc that reads its last word in the state of the others;
    ``failure``, the log10 weight of the failure arc out of its own state, to the state without the oldest word.
    """

    here: list[np.ndarray]
    count: list[np.ndarray]
    arc: list[np.ndarray]
    failure: list[np.ndarray]
    unknown: float

    def traverse(self, read: np.ndarray) -> np.ndarray:
        """log10 of the weights on the way over each token that is read.

        The state before a token is the longest n-gram ending there that training holds: where the arc
        of the token before led to. All tokens take their step together, since that state is known for each.
        """
        order = len(self.here)
        at = np.flatnonzero(read)
        score = np.full(len(at), self.unknown)
        open_ = np.ones(len(at), bool)  # no arc taken yet
        total = np.zeros(len(at))
        for words in range(order - 1, 0, -1):
            state = self.here[words - 1][at - 1]
            is_state = self.count[words - 1][state] > 0
            gram = self.here[words][at]
            taken = open_ & is_state & (self.count[words][gram] > 0)
            total[taken] += self.arc[words][gram[taken]]
            open_ &= ~taken
            fails = open_ & is_state
            total[fails] += self.failure[words - 1][state[fails]]
        gram = self.here[0][at]
        known = self.count[0][gram] > 0
        score = np.where(known, self.arc[0][gram], self.unknown)
        total[open_] += score[open_]
        return total


def automaton(here: list[np.ndarray], count: list[np.ndarray], stats: tuple[int, int, int, int], p: LmParams) -> Automaton:
    """The part of the automaton over these n-grams; ``count[k - 1]`` has the training counts of the distinct k-grams."""
    v, n1, n2, n = stats
    d = n1 / (n1 + 2 * n2) if n1 else 0.5
    unknown = d * v / n if n else 1.0
    prob = [np.where(count[0] > 0, (count[0] - d) / max(n, 1), unknown)]
    failure = []
    for k in range(2, len(here) + 1):
        some = np.zeros(len(count[k - 1]), np.int64)
        some[here[k - 1][::-1]] = np.arange(len(here[k - 1]))[::-1]  # a token at which each n-gram ends
        c = count[k - 2][here[k - 2][np.maximum(some - 1, 0)]].astype(float)
        m = p.strength(c, k - 1)
        prob.append(np.divide(count[k - 1] + m * prob[k - 2][here[k - 2][some]], c + m, out=np.ones(len(c)), where=c > 0))
        own = count[k - 2].astype(float)
        m = p.strength(own, k - 1)
        failure.append(np.log10(np.divide(m, own + m, out=np.ones(len(own)), where=own > 0)))
    return Automaton(here, count, [np.log10(np.maximum(x, 1e-300)) for x in prob], failure, float(np.log10(unknown)))


def walk(here: list[np.ndarray], count: list[np.ndarray], owner: np.ndarray, texts: int, stats: tuple[int, int, int, int], p: LmParams) -> tuple:
    """Base and model log10 scores, tokens and known tokens of each text."""
    v, _, _, n = stats
    read = np.ones(len(owner), bool)  # start tokens are not read
    begins = np.flatnonzero(np.diff(owner, prepend=-1))
    for j in range(max(1, p.order - 1)):
        read[begins + j] = False
    who = owner[read]
    c1 = count[0][here[0][read]]
    add = lambda x: np.bincount(who, x, texts)
    score = automaton(here, count, stats, p).traverse(read)
    return add(np.log10((c1 + 1) / (n + v + 1))), add(score), np.bincount(who, minlength=texts), np.bincount(who, c1 > 0, texts).astype(np.int64)


def score_texts(docs: DataFrame, p: LmParams = LmParams(), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Scores every row of ``docs`` under a model of the rows outside the held-out fold; columns as in ``OUT``."""
    fold = F.coalesce(F.crc32(F.col(id_col).cast("string")) % p.fold == p.held, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), fold.alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = stored(_blocks(rows, p), "zstd", BLOCK_ROWS)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(4, int(p.order * total / 8 // p.grams_a_shard).bit_length())
    width = min(64, max(bits, int(p.order * total / 4).bit_length() + 20))
    answers = stored(_totals(_requests(blocks, bits, width, p)))
    stats = answers.filter("block is null").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("v", "n1", "n2", "n")]).first()
    stats = tuple(int(x) for x in stats)

    def run(block: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        outs = []
        for ids, held, lengths, texts in zip(block["ids"], block["held"], block["lengths"], block["texts"], strict=True):
            grams, owner = _grams(_texts(lengths, texts), p.order)
            here, counts = [], []
            for k, g in enumerate(_keyed(grams, width), 1):
                mine = got[got["k"] == k].sort_values("shard")
                counts.append(np.concatenate([_counts_of(x) for x in mine["counts"]]))
                here.append(np.unique(g, return_inverse=True)[1])
            base, score, n_tokens, n_known = walk(here, counts, owner, len(lengths), stats, p)
            outs.append(pd.DataFrame({"doc_id": ids, "held_out": held, "n_tokens": n_tokens, "n_known": n_known, "train_tokens": stats[3], "base_score": base, "score": score}))
        return pd.concat(outs) if outs else pd.DataFrame(columns=[x.split()[0] for x in OUT.split(", ")])

    asked = answers.filter("block is not null").select("k", "shard", "block", "counts")
    out = blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInPandas(run, OUT)
    return out.withColumnRenamed("doc_id", id_col)
