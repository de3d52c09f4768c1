"""Phrases of two and three words, counted in quotient filters and scored for collocation.

A text is lower-cased (A to Z), split at ``. , ; : ! ?`` and line ends into pieces, and these at
spaces and tabs into words. All counts are of one language (null: ``und``). A candidate is a phrase
whose words follow each other in a piece ``least`` times or more. Cut in two, its parts have counts
l and r; its score is the floor of ``1000000 * a * a / (l * r)`` at the cut where that is least (of
equal ones the first). Candidates inside a longer one that accounts for ``inside`` per cent of their
count or more are dropped.

1. Texts become blocks of word numbers, with a dictionary of the block's own. Words that stand in a
   language fewer than ``least`` times can't be part of a candidate, nor of what is divided by, so
   only the others are given ids, the same in all blocks. A block asks for the ids of its distinct
   words by a join; words that stand in very many blocks are dealt to several tasks.
2. Each block's pairs and triples of such words are packed, permuted and counted in a counting
   quotient filter (``quotient_filter``), which is cut into shards by its leading bits. Filters of a
   shard are merged. There are as many shards as the number of words asks for; beyond ``fan_bits``
   they are split in rounds, groups of filters being merged in between, so no round deals a filter
   in more than two to the power of ``fan_bits`` parts. The permutation spreads keys evenly whatever
   the languages and words are, and a frequent phrase is one key of a filter, so no shard is hot.
3. Candidates leave the merged filters as rows; the counts of their parts, all at least ``least``,
   are in the vocabulary and among the pairs. Scores are worked out in decimals of 38 digits:
   1000000 * a * a is exact up to counts of 10 ** 16.

Defined results: null and empty texts have no words; a text of any length is read whole; texts count
as often as their rows do; equal scores and counts are ranked by the phrase's UTF-8 bytes; an empty
table gives no rows; no id is used and only the operator's own columns are returned, whatever others
``docs`` has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions.tables import numbered
from seqloom.llm import quotient_filter as qf
from seqloom.llm.words import UPPER
from seqloom.storage import discard, stored

BREAK = b"\xff"  # in no UTF-8 text
_FOLD = bytes.maketrans(UPPER.encode() + b".,;:!?\x0b\x0c\r\t", UPPER.lower().encode() + b"\n" * 9 + b" ")


@dataclass(frozen=True)
class CollocationParams:
    """``block_words``: words of a block. ``filter_keys``: phrases that a task counts at a time, ``shard_keys``: that a shard has at most before filters are merged.

    ``same_key``: rows of one key that a join deals to one task, ``rank_rows``: rows ranked in one place, about.
    """

    least: int = 10
    inside: int = 50
    top: int = 2000
    block_words: int = 800_000
    text_bytes: int = 1 << 20
    filter_keys: int = 3_000_000
    shard_keys: int = 2_000_000
    fan_bits: int = 8
    same_key: int = 50_000
    rank_rows: int = 200_000


class _Block(dict):
    """Words of a language with the numbers that this block gives them; 0 is a break between pieces."""

    def __init__(self) -> None:
        super().__init__({BREAK: 0})
        self.codes: list[int] = [0]
        self.skip, self.bytes = 1, 0  # leading codes that were counted before

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.bytes += len(word)
        return n

    def add(self, words: list[bytes]) -> None:
        self.codes += map(self.__getitem__, words)

    def row(self, lang: str) -> tuple:
        codes = np.array(self.codes, "<u4")
        counts = np.bincount(codes[self.skip :], minlength=len(self))[1:]
        return lang, [w for w in self if w != BREAK], counts, self.skip, zstandard.ZstdCompressor(level=1).compress(codes.tobytes())

    def goes_on(self) -> _Block:
        """The next block, with the last two words of this one before it."""
        names = list(self)
        after = _Block()
        after.add([names[c] for c in self.codes[-2:]])
        after.skip = len(after.codes)
        return after


def _slices(text: str, most: int) -> Iterator[bytes]:
    """The folded text in runs of about ``most`` bytes that end where a word does."""
    data = text.encode("utf-8", "surrogatepass").translate(_FOLD)
    at = 0
    while at < len(data):
        to = len(data)
        if at + most < to:
            ends = [i for i in (data.find(b" ", at + most), data.find(b"\n", at + most)) if i >= 0]
            to = min(ends, default=to)
        yield data[at:to]
        at = to


def _blocks(docs: DataFrame, p: CollocationParams, text_col: str, lang_col: str) -> DataFrame:
    """(block, lang, words, counts, skip, codes): all texts as runs of word numbers."""
    schema = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("skip", pa.int32()), ("codes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        open_: dict[str, _Block] = {}

        def sealed(lang: str) -> pa.RecordBatch:
            nonlocal at
            name, words, counts, skip, codes = open_[lang].row(lang)
            at += 1
            columns = ([at - 1], [name], [words], [counts], [skip], [codes])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                if not text.is_valid:
                    continue
                block = open_.setdefault(lang, _Block())
                for part in _slices(text.as_py(), p.text_bytes):
                    block.add(part.replace(b"\n", b" " + BREAK + b" ").split())
                    if len(block.codes) >= p.block_words or block.bytes > p.text_bytes * 16:
                        yield sealed(lang)
                        block = open_[lang] = block.goes_on()
                block.codes.append(0)
            while sum(len(b.codes) for b in open_.values()) > 4 * p.block_words:  # many languages
                largest = max(open_, key=lambda x: len(open_[x].codes))
                yield sealed(largest)
                del open_[largest]
        for lang in open_:
            yield sealed(lang)

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    kinds = "block long, lang string, words array<string>, counts array<long>, skip int, codes binary"
    return docs.select(lang.alias("lang"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, kinds)


def _looked_up(rows: DataFrame, table: DataFrame, keys: list[str], uses: str, spread: Column, most: int) -> DataFrame:
    """``rows`` joined with the one row of ``table`` for their keys.

    ``uses`` says how many rows ask for a key. One that more than ``most`` ask for has a copy for each ``most`` rows, and these are dealt by
    ``spread``; such keys are broadcast, and there are no more of them than rows over ``most``, which ``_most`` holds to 10,000.
    """
    copies = table.withColumn("_copies", (F.lit(1) + F.col(uses) / most).cast("int")).drop(uses)
    hot = F.broadcast(copies.filter("_copies > 1").select(*keys, F.col("_copies").alias("_dealt")))
    dealt = rows.join(hot, keys, "left").withColumn("_task", F.pmod(F.xxhash64(spread), F.coalesce("_dealt", F.lit(1))).cast("int")).drop("_dealt")
    return dealt.join(copies.withColumn("_task", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies"), [*keys, "_task"]).drop("_task")


def _most(rows: int, p: CollocationParams) -> int:
    return max(p.same_key, rows // 10_000)


def _phrases(codes: np.ndarray, skip: int, word_bits: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Permuted keys of the pairs and triples that end at or after ``skip``; 0 is a break or a word without an id."""
    pair = (codes[:-1] > 0) & (codes[1:] > 0)
    triple = pair[:-1] & pair[1:]
    pair[: max(0, skip - 1)] = False
    triple[: max(0, skip - 2)] = False
    i, j = np.flatnonzero(pair), np.flatnonzero(triple)
    a, b, c = (np.concatenate(x) for x in ((codes[i], codes[j]), (codes[i + 1], codes[j + 1]), (np.zeros(len(i), np.uint64), codes[j + 2])))
    return qf.permute(*qf.pack(a, b, c, word_bits), half)


FILTERS = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("filter", pa.binary())])


def _cut(high: np.ndarray, low: np.ndarray, counts: np.ndarray, half: int, bits: int, part: int) -> pa.RecordBatch:
    """The filter of each shard of ``bits`` leading bits."""
    shards, cuts = qf.split(high, half, bits)
    data = [qf.encode(high[i:j], low[i:j], counts[i:j], half, bits) for i, j in zip(cuts, cuts[1:])]  # noqa: B905
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array([part] * len(data), pa.int64()), pa.array(data, pa.binary())], schema=FILTERS)


def _refined(half: int, now: int, after: int) -> Callable[[pa.Table], pa.Table]:
    """Merges the filters of a group and cuts them by ``after`` leading bits."""

    def refined(group: pa.Table) -> pa.Table:
        shard, part = group["shard"][0].as_py(), group["part"][0].as_py()
        return pa.Table.from_batches([_cut(*qf.merge(group["filter"].to_pylist(), half, now, shard), half, after, part)])

    return refined


def count_phrases(blocks: DataFrame, word_bits: int, words: int, p: CollocationParams) -> DataFrame:
    """(w1, w2, w3, a): pairs (w3 = 0) and triples of ids that stand ``least`` times or more; ``blocks`` has (block, skip, codes, given)."""
    half = qf.half_bits(word_bits)
    bits = min(half, max(0, (2 * words // p.shard_keys).bit_length()))
    steps = list(range(min(bits, p.fan_bits), bits, p.fan_bits)) + [bits]  # leading bits after each round

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, unpacker, found, size = TaskContext.get().partitionId() << 20, zstandard.ZstdDecompressor(), [], 0

        def filters() -> pa.RecordBatch:
            return _cut(*qf.summed(*(np.concatenate(x) for x in zip(*found, strict=True)), None, half), half, steps[0], part)

        for batch in batches:
            for skip, codes, given in zip(batch.column("skip").to_pylist(), batch.column("codes"), batch.column("given"), strict=True):
                local = np.frombuffer(unpacker.decompress(codes.as_py()), "<u4")
                given = given.values.to_numpy(zero_copy_only=False)
                ids = np.zeros(int(max(local.max(), (given >> 40).max())) + 1, np.uint64)
                ids[given >> 40] = (given & ((1 << 40) - 1)).astype(np.uint64)
                found.append(_phrases(ids[local], skip, word_bits, half))
                size += len(found[-1][0])
                if size >= p.filter_keys:
                    yield filters()
                    part, found, size = part + 1, [], 0
        if size:
            yield filters()

    kinds = "shard long, part long, filter binary"
    filters = blocks.select("skip", "codes", "given").mapInArrow(counted, kinds)
    for now, after in zip(steps, steps[1:]):  # noqa: B905
        fewer = F.expr(f"pmod(xxhash64(part), greatest(1, {2 * words // p.filter_keys} div {1 << now}))")  # so many groups that each has about filter_keys keys
        filters = filters.withColumn("part", fewer).groupBy("shard", "part").applyInArrow(_refined(half, now, after), kinds)

    def frequent(group: pa.Table) -> pa.Table:
        high, low, counts = qf.merge(group["filter"].to_pylist(), half, bits, group["shard"][0].as_py())
        keep = counts >= p.least
        parts = qf.unpack(*qf.restore(high[keep], low[keep], half), word_bits)
        return pa.table([*(pa.array(x.astype(np.int64)) for x in parts), pa.array(counts[keep])], names=["w1", "w2", "w3", "a"])

    return filters.groupBy("shard").applyInArrow(frequent, "w1 long, w2 long, w3 long, a long")


def mine_collocations(docs: DataFrame, p: CollocationParams = CollocationParams(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's best phrases: lang, rank (from 1), phrase, a, l, r, n, score."""
    blocks = stored(_blocks(docs, p, text_col, lang_col), "zstd")
    each = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("lang", F.col("x.words").alias("word"), F.col("x.counts").alias("k"))
    totals = stored(each.groupBy("lang", "word").agg(F.sum("k").alias("f"), F.count("*").alias("blocks")))
    words_of = totals.groupBy("lang").agg(F.sum("f").alias("n"))
    words, asking = totals.agg(F.coalesce(F.sum("f"), F.lit(0)), F.coalesce(F.sum("blocks"), F.lit(0))).first()
    often = totals.filter(F.col("f") >= p.least)
    vocabulary = stored(numbered(often, "id", -F.col("f"), "lang", "word").withColumn("id", F.col("id") + 1))
    word_bits = max(1, vocabulary.count().bit_length())
    asked = blocks.select("block", "lang", F.posexplode("words").alias("at", "word"))
    answered = _looked_up(asked, vocabulary.select("lang", "word", "id", "blocks"), ["lang", "word"], "blocks", F.col("block"), _most(asking, p))
    given = answered.groupBy("block").agg(F.collect_list(F.shiftleft(F.col("at").cast("long") + 1, 40) + F.col("id")).alias("given"))  # at most block_words
    found = stored(count_phrases(blocks.select("block", "skip", "codes").join(given, "block"), word_bits, words, p))
    discard(blocks)
    return _best(found, vocabulary, words_of, p)


def _best(found: DataFrame, vocabulary: DataFrame, words_of: DataFrame, p: CollocationParams) -> DataFrame:
    """Ranked phrases of the candidates (w1, w2, w3, a)."""
    rows = found.count()
    most, spread = _most(rows, p), F.struct("w1", "w2", "w3")
    pairs, triples = found.filter("w3 = 0"), found.filter("w3 > 0")
    # how often each word begins and ends a pair; how often each pair begins and ends a triple, and the most frequent of these
    uses = pairs.select(F.explode(F.array(F.struct(F.col("w1").alias("id"), F.lit(1).alias("starts")), F.struct(F.col("w2").alias("id"), F.lit(0).alias("starts")))).alias("x")).select("x.*")
    words = vocabulary.join(uses.groupBy("id").agg(F.sum("starts").alias("starts"), F.sum(1 - F.col("starts")).alias("ends")), "id")
    sides = F.array(F.struct(F.col("w1").alias("p1"), F.col("w2").alias("p2"), "a", F.lit(1).alias("starts")), F.struct(F.col("w2").alias("p1"), F.col("w3").alias("p2"), "a", F.lit(0).alias("starts")))
    around = triples.select(F.explode(sides).alias("x")).select("x.*").groupBy("p1", "p2").agg(F.max("a").alias("longer"), F.sum("starts").alias("starts"), F.sum(1 - F.col("starts")).alias("ends"))

    first = _looked_up(pairs, words.select(F.col("id").alias("w1"), "lang", F.col("f").alias("f1"), "starts"), ["w1"], "starts", spread, most)
    both = _looked_up(first, words.select(F.col("id").alias("w2"), F.col("f").alias("f2"), "ends"), ["w2"], "ends", spread, most)
    met = (F.col("w1") == F.col("p1")) & (F.col("w2") == F.col("p2"))
    pair = stored(both.join(around, met, "left").select("lang", "w1", "w2", "w3", "a", "f1", "f2", "longer", F.coalesce("starts", F.lit(0)).alias("starts"), F.coalesce("ends", F.lit(0)).alias("ends")))

    def score(left_count: str, right_count: str) -> Column:
        return F.expr(f"(cast(1000000 as decimal(38,0)) * a * a) div (cast({left_count} as decimal(19,0)) * cast({right_count} as decimal(19,0)))")

    twos = pair.filter(f"longer is null or 100 * longer < {p.inside} * a").select("lang", "w1", "w2", "w3", "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score("f1", "f2").alias("score"))
    begun = _looked_up(triples, pair.select("w1", "w2", "lang", "f1", F.col("a").alias("f12"), "starts"), ["w1", "w2"], "starts", spread, most)
    full = _looked_up(begun, pair.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"), F.col("f2").alias("f3"), "ends"), ["w2", "w3"], "ends", spread, most)
    full = full.withColumn("s1", score("f1", "f23")).withColumn("s2", score("f12", "f3"))
    early = F.col("s1") <= F.col("s2")
    threes = full.select("lang", "w1", "w2", "w3", "a", F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    slice_ = F.pmod(F.xxhash64("w1", "w2", "w3"), F.lit(1 + rows // p.rank_rows))
    best = twos.unionByName(threes).withColumn("slice", slice_)
    for keys in (["lang", "slice"], ["lang"]):  # all that tie with the last place stay, until phrases tell them apart
        best = best.withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("a").desc()))).filter(F.col("rank") <= p.top)
    for k in (1, 2, 3):
        names = vocabulary.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"word{k}"))
        best = best.join(names, f"w{k}", "left")  # a pair has no third word
    named = best.withColumn("phrase", F.concat_ws(" ", "word1", "word2", "word3"))
    for keys in (["lang", "slice"], ["lang"]):
        named = named.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))).filter(F.col("rank") <= p.top)
    return named.join(words_of, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
