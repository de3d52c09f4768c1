"""Encoding and decoding against the tokenizers library, piece by piece and over tables."""

import hashlib
import random
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqloom.llm.bpe import NEVER, BpeModel, BpeParams, TextCoder, decode_ids, encode_texts
from seqloom.llm.queries import op11_bpe_speculate, tokenizer_path

ODD = [
    None, "", "  \n\t", "<|endoftext|>", "a<|endoftext|>b <|startoftext|><|EndOfText|>", "<|endoftext|", "a" * 3000, "ab" * 900 + " x", "ΑΣ ΑΣ, ὈΔΥΣΣΕΎΣ", "don't WE'RE x've 's",
    "café café ́x", "a b　c\u0085d\x1ce", "\x00\x7f", "\U0001f600\U0001f600 中文", "İẞß", "12345 1a2b", "...---###",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def coder():
    return TextCoder(tokenizer_path(), BpeParams(cached_words=400, long_word=40))


def ids_of(data):
    return list(array("I", data))


def random_texts(n, seed):
    rng = random.Random(seed)
    letters = [*"abcdeinorst", "'", " ", "  ", "é", "É", "́", "Σ", "中", "\U0001f600", " ", "\x00", "1", ".", "-"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 70))) for _ in range(n)]


def test_same_ids_as_the_library(coder, library):
    texts = ODD + random_texts(1500, 1)
    for i in range(0, len(texts), 100):  # many small calls turn the cache over
        part = texts[i : i + 100]
        want = [library.encode(t or "", add_special_tokens=False).ids for t in part]
        got = [ids_of(x) for x in coder.encode(part)]
        assert got == want
        assert [coder.model.decode(x) for x in got] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_compatible_pairs_are_those_that_merging_keeps_apart(coder):
    m = coder.model
    rng = np.random.default_rng(4)
    short = [i for name, i in m.id_of.items() if len(name) < 6 and not name.endswith("</w>") and name.isascii()]
    ends = [i for name, i in m.id_of.items() if len(name) < 9 and name.endswith("</w>") and name.isascii()]
    a, b = rng.choice(short, 4000), rng.choice(ends, 4000)
    same = m.compatible(a, b)
    assert 0 < same.sum() < len(a)
    for x, y, good in zip(a.tolist(), b.tolist(), same.tolist()):
        assert (m.merged(m.token[x] + m.token[y].removesuffix("</w>")) == [x, y]) == good
    assert (m.verified(a << 32 | b) == same).all() and (m.verified(a << 32 | b) == same).all()  # looked up the second time


def test_two_ways_of_exact_merging_agree(coder):
    rng = random.Random(2)
    pieces = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 60))) for _ in range(800)] + ["aaaa", "aaaaa", "a"]
    assert coder.model.merged_together(pieces) == [coder.model.merged(x) for x in pieces]
    tokens, owner = coder.model.proposals(pieces)
    for k in range(0, len(pieces), 50):  # greedy: each token is the longest that fits
        left = pieces[k]
        for t in tokens[owner == k]:
            name = coder.model.token[t].removesuffix("</w>")
            assert left.startswith(name)
            longer = [left[:n] for n in range(len(name) + 1, len(left) + 1) if (left[:n] + "</w>" * (n == len(left))) in coder.model.id_of]
            assert not longer
            left = left[len(name) :]
        assert left == ""


def test_a_token_made_twice_is_refused(tmp_path):
    import json

    spec = {
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "Whitespace"}, "post_processor": None, "decoder": None,
        "model": {"type": "BPE", "end_of_word_suffix": None, "vocab": {"a": 0, "b": 1, "ab": 2, "ba": 3, "aba": 4}, "merges": ["a b", "b a", "ab a", "a ba"]},
    }
    at = tmp_path / "t.json"
    at.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="made by two merges"):
        BpeModel(str(at))
    spec["model"]["merges"].pop()
    at.write_text(json.dumps(spec))
    m = BpeModel(str(at))
    assert m.encode_pieces(["abab", "aba", "baab"]) == [[2, 2], [4], [3, 2]]
    assert m.compatible(np.array([2]), np.array([0])).tolist() == [False] and m._rank_of(np.array([0]), np.array([0])).tolist() == [NEVER]


def test_tables(spark, library):
    texts = ODD + random_texts(60, 3) + ["same", "same", "x" * 100_000]
    rows = [(None if i == 5 else i % 70, t, "no", b"no") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids binary")
    out = encode_texts(df, tokenizer_path())
    assert out.columns == ["doc_id", "ids", "decoded"]
    got = sorted((str(r.doc_id), bytes(r.ids), r.decoded) for r in out.collect())
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), array("I", ids).tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    again = decode_ids(out.withColumn("ids", F.when(F.col("doc_id") > 3, F.col("ids"))), tokenizer_path(), to="back").filter("doc_id > 3 and back <> decoded or doc_id <= 3 and back is not null")
    assert again.count() == 0
    assert encode_texts(df.limit(0), tokenizer_path()).count() == 0


def test_query_against_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = op11_bpe_speculate(spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
