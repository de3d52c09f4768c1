"""Quotient filters by round trips, phrase mining against counting by hand."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import quotient_filter as qf
from seqloom.llm.collocations import CollocationParams, mine_collocations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@pytest.mark.parametrize("word_bits", [1, 2, 7, 16, 21, 22, 33, 40])
def test_filters(word_bits):
    rng = np.random.default_rng(word_bits)
    half = qf.half_bits(word_bits)
    words = [rng.integers(0, 1 << word_bits, 20_000).astype(np.uint64) for _ in range(3)]
    high, low = qf.permute(*qf.pack(*words, word_bits), half)
    back = qf.unpack(*qf.restore(high, low, half), word_bits)
    assert all((x == y).all() for x, y in zip(words, back))
    want = Counter(zip(high.tolist(), low.tolist()))
    want[next(iter(want))] += 700  # a wide counter
    more = np.array([next(iter(want))] * 700, np.uint64).reshape(-1, 2)
    keys = qf.summed(np.append(high, more[:, 0]), np.append(low, more[:, 1]), None, half)
    assert list(zip(*map(np.ndarray.tolist, keys))) == [(*k, n) for k, n in sorted(want.items())]
    for bits in {0, min(half, 3), min(half, 8)}:
        shards, cuts = qf.split(keys[0], half, bits)
        filters = [qf.encode(*(x[i:j] for x in keys), half, bits) for i, j in zip(cuts, cuts[1:])]
        again = [qf.decode(f, half, bits, int(s)) for f, s in zip(filters, shards)]
        assert all((np.concatenate(x) == y).all() for x, y in zip(zip(*again), keys))
        both = qf.merge([filters[0], filters[0]], half, bits, int(shards[0]))
        assert (both[2] == 2 * keys[2][: cuts[1]]).all() and (both[0] == keys[0][: cuts[1]]).all()
    if word_bits >= 16:
        assert len(qf.encode(*keys, half, 0)) < len(keys[0]) * (2 * half / 8 + 1)  # smaller than the keys with a byte each
    assert qf.summed(high[:0], low[:0], None, half)[2].tolist() == []


def by_hand(rows, p):
    out = []
    counts = {}
    for lang, text in rows:
        text = (text or "").translate(str.maketrans(UPPER, UPPER.lower()))
        f = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, f in counts.items():
        cand = {g: a for g, a in f.items() if len(g) > 1 and a >= p.least}
        n, rows = sum(a for g, a in f.items() if len(g) == 1), []
        for g, a in cand.items():
            if len(g) == 2 and any(100 * b >= p.inside * a for h, b in cand.items() if len(h) == 3 and g in (h[:2], h[1:])):
                continue
            score, k = min((1000000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, g.decode(), -a, left, right, n, -s) for i, (s, a, g, left, right) in enumerate(sorted(rows)[: p.top])]
    return sorted(out)


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    words = ["New", "York", "city", "the", "of", "É", "é", "x y", "\U0001f600", "￿", "and", "a", "\x0e"]
    marks = [" ", " ", " ", "  ", "\t", ", ", ".\n", " ! ", "\r"]
    rows = []
    for _ in range(n):
        w = [str(rng.choice(words)) + str(rng.choice(marks)) for _ in range(int(rng.integers(0, 30)))]
        rows.append((str(rng.choice(["en", "de", None, "fr"], p=[0.7, 0.1, 0.1, 0.1])), "".join(w)))
    return [(None if x == "None" else x, t) for x, t in rows]


def test_against_counting(spark):
    rows = corpus(0, 300) + [("en", None), ("en", ""), (None, "only. once."), ("en", "New York city " * 3000), ("de", "long " + "y" * 5000 + " long " + "y" * 5000), ("xx", "z")] + [("en", "Twice told, TWICE told")] * 5
    df = spark.createDataFrame([(i, *r, "q", 1) for i, r in enumerate(rows)], "doc_id long, lang string, text string, word string, a int").repartition(3)
    tiny = {"block_words": 50, "text_bytes": 300, "filter_keys": 400, "shard_keys": 300, "fan_bits": 2, "same_key": 20, "rank_rows": 10}
    for p in (CollocationParams(least=3, top=12), CollocationParams(least=2, inside=80, **tiny), CollocationParams(least=4, top=40, **tiny)):
        out = mine_collocations(df, p)
        assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, out.collect())) == by_hand(rows, p)


def test_large_counts_are_exact(spark):
    from seqloom.llm.collocations import _best

    big = 3_000_000_000
    found = spark.createDataFrame([(1, 2, 0, big - 7)], "w1 long, w2 long, w3 long, a long")
    words = spark.createDataFrame([(1, "p", big, "en"), (2, "q", big + 11, "en")], "id long, word string, f long, lang string")
    row = _best(found, words, spark.createDataFrame([("en", 3 * big)], "lang string, n long"), CollocationParams()).first()
    assert (row.phrase, row.l, row.r, row.n) == ("p q", big, big + 11, 3 * big)
    assert row.score == 1000000 * (big - 7) ** 2 // (big * (big + 11))


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert mine_collocations(none).count() == 0
    assert mine_collocations(spark.createDataFrame([("en", "a b c"), ("en", None)], "lang string, text string").withColumn("id", F.lit(1))).count() == 0
