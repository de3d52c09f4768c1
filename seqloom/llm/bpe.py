"""Byte-pair encoding by speculation and verification, and decoding.

A word's proposal is its greedy longest match against the vocabulary. It is the encoding if, and
only if, every two neighbouring tokens are compatible: merging the two alone, no merge ever crosses
the place where they meet. Compatibility is worked out for all new pairs of a batch at once in
arrays: both tokens are taken apart again, always the part at the boundary that was formed last,
and at each step the two parts that meet are looked up in the merge table. Only words with an
incompatible pair are merged exactly, by a queue of merges in the order of rank and place.

The equivalence needs a merge table in which each token is made by one merge, after the merges that
make its halves; ``BpeModel`` checks that when it reads the file and refuses any other. Tokens that
do not come out of their own characters are never proposed.

Normalisation and the split into words are the file's own: plain words (ASCII and Latin-1 letters,
digits and marks without an apostrophe) are split here, all others by the file's rules. White space
is never part of a token, so texts are cut there first and each distinct word is encoded once in a
worker; a cache of two generations keeps ``cached_words`` words each, none longer than ``long_word``
bytes.

Defined results: a null or empty text has no ids and decodes to an empty text; texts of any length
are encoded whole, and so are words of any length; strings of special tokens in a text are those
tokens, as in the tokenizers library; repeated rows and rows without an id are encoded row by row;
an empty table gives no rows; only ``id_col``, ``ids`` and ``decoded`` are returned, whatever other
columns ``docs`` has.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.packing import _PIECES, _byte_letters
from seqloom.llm.words import TO_LOWER

NEVER = np.iinfo(np.int64).max
#: Byte letters lie below this; the end of a word is one more. Pieces up to SHORT letters are merged together, longer ones alone.
LETTERS = END = 512
SHORT = 64


@dataclass(frozen=True)
class BpeParams:
    """``cached_words``: words of a generation that a worker keeps. ``chunk_bytes``: texts of about so many bytes are encoded at a time."""

    cached_words: int = 120_000
    long_word: int = 256
    chunk_bytes: int = 4 << 20


class BpeModel:
    """Vocabulary and merges of a tokenizer file whose last character of a word carries a suffix (or none)."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.rules = Tokenizer.from_file(path)  # its normalizer and pre-tokenizer; the model is our own
        self.id_of: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in spec["added_tokens"]):
            raise ValueError("special tokens that take neighbouring characters are not supported")
        size = 1 + max([*self.id_of.values(), *self.special.values()])
        self.token: list[str] = [""] * size
        for name, i in [*self.id_of.items(), *self.special.items()]:
            self.token[i] = name
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        pairs = np.array([(self.id_of[a], self.id_of[b]) for a, b in merges], np.int64).reshape(-1, 2)
        made = np.array([self.id_of[a + b] for a, b in merges], np.int64)
        ranks = np.arange(len(merges))
        self.left, self.right, self.rank = np.full(size, -1), np.full(size, -1), np.full(size, -1)
        self.left[made], self.right[made], self.rank[made] = pairs[:, 0], pairs[:, 1], ranks
        if len(np.unique(made)) < len(made) or (self.rank[pairs].max(axis=1, initial=-1) >= ranks).any():
            raise ValueError("a token is made by two merges, or before its halves")
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(keys)
        self.keys, self.key_ranks = np.append(keys[order], NEVER), np.append(ranks[order], NEVER)
        self.merge_rank = dict(zip(map(tuple, pairs.tolist()), ranks.tolist(), strict=True))
        self.made, self.made_of = made, made.tolist()
        sound = np.ones(size, bool)
        sound[made] = self.compatible(pairs[:, 0], pairs[:, 1], ranks)
        # the letters of each token and whether it ends a word; halves come first
        spelt: list[tuple[str, bool] | None] = [None] * size
        for name, i in self.id_of.items():
            if self.rank[i] < 0:
                ends = bool(self.suffix) and name.endswith(self.suffix) and len(name) > len(self.suffix)
                spelt[i] = (name.removesuffix(self.suffix) if ends else name, ends)
        for i, a, b in zip(self.made_of, *pairs.T.tolist(), strict=True):
            sound[i] &= sound[a] and sound[b]
            spelt[i] = (spelt[a][0] + spelt[b][0], spelt[b][1])
        self.base = np.full((2, LETTERS), -1)  # ids of single letters: within a word, at its end
        steps: dict[tuple[int, int], int] = {}
        accept = [-1]
        for i in sorted(self.id_of.values()):
            if not sound[i]:
                continue
            text, ends = spelt[i]
            if len(text) == 1:
                self.base[int(ends), ord(text)] = i
                if not self.suffix:
                    self.base[1, ord(text)] = i
            node = 0
            for c in [*map(ord, text), *[END] * ends]:
                node = steps.setdefault((node, c), len(accept))
                if node == len(accept):
                    accept.append(-1)
            accept[node] = i
        self.accept = np.array(accept)
        edges = np.array([(n << 10 | c, m) for (n, c), m in steps.items()], np.int64).reshape(-1, 2)
        edges = edges[np.argsort(edges[:, 0])]
        self.edges, self.leads = np.append(edges[:, 0], NEVER), np.append(edges[:, 1], 0)
        self.known = np.empty(0, np.int64)  # pairs judged before, as keys
        self.judged = np.empty(0, bool)

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.key_ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | int = NEVER) -> np.ndarray:
        """Whether no merge of rank below ``before`` crosses from token a to token b."""
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = a.copy(), b.copy()
        x_until = y_until = np.broadcast_to(np.asarray(before, np.int64), a.shape)  # ranks of the merges that take x and y away
        while len(at):
            m = self._rank_of(x, y)
            # of equal merges the one further left comes first: y's own loses to a crossing one, x's own does not
            crosses = (m < x_until) & (m <= y_until)
            good[at[crosses]] = False
            go = ~crosses & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            at, x, y, x_until, y_until = at[go], x[go], y[go], x_until[go], y_until[go]
            split_x = self.rank[x] > self.rank[y]
            x_until, y_until = np.where(split_x, self.rank[x], x_until), np.where(split_x, y_until, self.rank[y])
            x, y = np.where(split_x, self.right[x], x), np.where(split_x, y, self.left[y])
        return good

    def proposals(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all pieces, each read in step with the others: tokens, and the piece each belongs to."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) + bool(self.suffix)
        ends = np.cumsum(sizes)
        codes = np.full(int(sizes.sum()) + 1, END)
        letters = np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4")
        inner = np.ones(len(codes), bool)
        inner[-1] = False
        if self.suffix:
            inner[ends - 1] = False
        codes[inner] = letters
        word, start = np.flatnonzero(sizes > bool(self.suffix)), (ends - sizes)[sizes > bool(self.suffix)]
        pos, node, token, to = start.copy(), np.zeros(len(word), np.int64), np.full(len(word), -1), start.copy()
        owners, tokens = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(word):
            key = node << 10 | codes[pos]
            at = np.searchsorted(self.edges, key)
            hit = (self.edges[at] == key) & (pos < ends[word])
            node = np.where(hit, self.leads[at], node)
            pos = pos + hit
            found = np.where(hit, self.accept[node], -1)
            if self.suffix:  # the last letter goes with the end of the word
                found[(pos == ends[word] - 1)] = -1
            token, to = np.where(found >= 0, found, token), np.where(found >= 0, pos, to)
            stuck = ~hit
            if stuck.any():
                if (token[stuck] < 0).any():
                    raise ValueError("no token for a letter")
                owners.append(word[stuck])
                tokens.append(token[stuck])
                pos, node, token = np.where(stuck, to, pos), np.where(stuck, 0, node), np.where(stuck, -1, token)
                go = ~stuck | (pos < ends[word])
                word, pos, node, token, to = word[go], pos[go], node[go], token[go], to[go]
        owner, token = np.concatenate(owners), np.concatenate(tokens)
        order = np.argsort(owner, kind="stable")
        return token[order], owner[order]

    def merged_together(self, pieces: list[str]) -> list[list[int]]:
        """Exact merging of many short pieces: in each, again and again, the merge of lowest rank, leftmost first."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        letters = np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4").astype(np.int64)
        at_end = np.zeros(len(letters), np.int64)
        at_end[ends - 1] = 1
        token, word = self.base[at_end, letters], np.repeat(np.arange(len(pieces)), sizes)
        rank = np.full(len(token), NEVER)
        rank[:-1] = np.where(word[1:] == word[:-1], self._rank_of(token[:-1], token[1:]), NEVER)
        out: list[list[int]] = [[] for _ in pieces]
        while len(token):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, starts)
            many = np.diff(np.append(starts, len(token)))
            open_ = np.repeat(least < NEVER, many)
            shut = np.flatnonzero(least == NEVER)
            done = token[~open_].tolist()
            at = 0
            for w, k in zip(word[starts[shut]].tolist(), many[shut].tolist(), strict=True):
                out[w] = done[at : at + k]
                at += k
            token, word, rank, least = token[open_], word[open_], rank[open_], np.repeat(least, many)[open_]
            if not len(token):
                break
            hit = np.flatnonzero(rank == least)
            hit = hit[np.append(True, word[hit][1:] != word[hit][:-1])]
            token[hit] = self.made[rank[hit]]
            there = np.ones(len(token), bool)
            there[hit + 1] = False
            hit = hit - np.arange(len(hit))  # places once the right halves are gone
            token, word, rank = token[there], word[there], rank[there]
            changed = np.concatenate([hit, hit[hit > 0] - 1])
            after = np.minimum(changed + 1, len(token) - 1)
            rank[changed] = np.where((word[after] == word[changed]) & (after > changed), self._rank_of(token[changed], token[after]), NEVER)
        return out

    def merged(self, piece: str) -> list[int]:
        """Exact merging of one long piece by a queue of merges."""
        letters = np.frombuffer(piece.encode("utf-32-le"), "<u4")
        tokens = self.base[0, letters].tolist()[:-1] + [int(self.base[1, letters[-1]])]
        after, before, alive = list(range(1, len(tokens) + 1)), list(range(-1, len(tokens) - 1)), [True] * len(tokens)
        queue = [(r, i, tokens[i], tokens[i + 1]) for i in range(len(tokens) - 1) if (r := self.merge_rank.get((tokens[i], tokens[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = after[i] if alive[i] else len(tokens)
            if j >= len(tokens) or tokens[i] != a or tokens[j] != b:
                continue  # one of the two has gone
            tokens[i], alive[j] = self.made_of[r], False
            after[i] = after[j]
            if after[i] < len(tokens):
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < len(tokens) and (s := self.merge_rank.get((tokens[p], tokens[q]))) is not None:
                    heapq.heappush(queue, (s, p, tokens[p], tokens[q]))
        return [t for t, there in zip(tokens, alive, strict=True) if there]

    def verified(self, keys: np.ndarray) -> np.ndarray:
        """Compatibility of pairs given as keys; pairs met before are looked up."""
        distinct, back = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != distinct[inside]
        fresh = distinct[new]
        answer = np.empty(len(distinct), bool)
        answer[new] = self.compatible(fresh >> 32, fresh & 0xFFFFFFFF)
        answer[~new] = self.judged[at[~new]]
        if len(self.known) > 2_000_000:  # a new start instead of ever more memory
            self.known, self.judged = np.empty(0, np.int64), np.empty(0, bool)
            at, new, fresh = np.zeros(len(distinct), int), np.ones(len(distinct), bool), distinct
        self.known, self.judged = np.insert(self.known, at[new], fresh), np.insert(self.judged, at[new], answer[new])
        return answer[back]

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each piece: proposals, verified all at once, and exact merging where one fails."""
        flat, owner = self.proposals(pieces)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        good = self.verified(flat[inner] << 32 | flat[inner + 1])
        cuts, ids = np.searchsorted(owner, np.arange(len(pieces) + 1)).tolist(), flat.tolist()
        found = [ids[i:j] for i, j in zip(cuts, cuts[1:])]  # noqa: B905
        failing = np.unique(owner[inner[~good]]).tolist()
        short = [k for k in failing if len(pieces[k]) <= SHORT]
        for k, x in zip(short, self.merged_together([pieces[k] for k in short]), strict=True):
            found[k] = x
        for k in failing:
            if len(pieces[k]) > SHORT:
                found[k] = self.merged(pieces[k])
        return found

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens in a row with a space between, as a tokenizer without a decoder writes them."""
        return " ".join(map(self.token.__getitem__, ids))


class TextCoder:
    """Encodes texts of a worker word by word; words it has met before are looked up."""

    def __init__(self, path: str, p: BpeParams) -> None:
        self.model, self.p = BpeModel(path), p
        if [x for x, _ in self.model.rules.pre_tokenizer.pre_tokenize_str("a b")] != ["a", "b"]:
            raise ValueError("white space must not be part of a token")
        self.now: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.letters = _byte_letters()
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.model.special, key=len, reverse=True))) + ")") if self.model.special else None

    def _pieces(self, word: bytes) -> list[str] | list[bytes]:
        """The pieces of a word: plain ones as they stand, others in byte letters."""
        if word.isalpha():
            return [word]
        plain = _PIECES.findall(word)
        if sum(map(len, plain)) == len(word):
            return plain
        rules = self.model.rules
        return [x for x, _ in rules.pre_tokenizer.pre_tokenize_str(rules.normalizer.normalize_str(word.decode()))]

    def _letters(self, piece: str | bytes) -> str:
        if isinstance(piece, str):
            return piece
        return piece.decode() if piece.isascii() else "".join([self.letters[c] for c in piece.decode().lower().encode()])

    def _encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        split = [self._pieces(w) for w in words]
        pieces = list({x for parts in split for x in parts})
        ids = {x: array("I", i).tobytes() for x, i in zip(pieces, self.model.encode_pieces(list(map(self._letters, pieces))), strict=True)}
        return {w: b"".join([ids[x] for x in parts]) if len(parts) != 1 else ids[parts[0]] for w, parts in zip(words, split, strict=True)}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        cut = []  # of each text: runs of words, and ids of special tokens between them
        for text in texts:
            parts = self.at_special.split(text or "") if self.at_special else [text or ""]
            cut.append([array("I", [self.model.special[x]]).tobytes() if i % 2 else x.encode().translate(TO_LOWER).split() for i, x in enumerate(parts)])
        met = {w for parts in cut for x in parts[::2] for w in x}
        kept = {w: ids for w in met if (ids := self.before.get(w)) is not None}
        new = [w for w in met if w not in self.now and w not in kept]
        kept |= self._encode_words(new)
        if len(self.now) + len(kept) > self.p.cached_words:
            self.before, self.now = self.now, {w: self.now[w] for w in met if w in self.now}
        long = {w: kept.pop(w) for w in new if len(w) > self.p.long_word}
        self.now |= kept
        look = self.now.__getitem__ if not long else lambda w: long[w] if w in long else self.now[w]
        return [b"".join([x if i % 2 else b"".join(map(look, x)) for i, x in enumerate(parts)]) for parts in cut]


@lru_cache(1)
def _coder(path: str, p: BpeParams) -> TextCoder:
    """A worker's coder: kept from task to task."""
    return TextCoder(path, p)


def _chunks(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` characters, as (from, to)."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 64
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_texts(docs: DataFrame, tokenizer_path: str, p: BpeParams = BpeParams(), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``ids`` (little-endian unsigned 32-bit numbers) and ``decoded``, the text that these ids give again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _coder(tokenizer_path, p)
        for pdf in batches:
            texts = pdf["text"].tolist()
            for i, j in _chunks(texts, p.chunk_bytes):
                ids = coder.encode(texts[i:j])
                yield pd.DataFrame({"id": pdf["id"].iloc[i:j].array, "ids": ids, "decoded": [coder.model.decode(array("I", x)) for x in ids]})

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, ids binary, decoded string")
    return out.withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, tokenizer_path: str, p: BpeParams = BpeParams(), ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the text that the ids of ``ids_col`` give; null ids give null."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        model = _coder(tokenizer_path, p).model
        return pd.Series([None if x is None else model.decode(array("I", x)) for x in ids], dtype=object)

    return df.withColumn(to, text(F.col(ids_col)))
