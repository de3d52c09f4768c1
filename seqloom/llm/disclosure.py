"""Personal data and the terms that give it away, with DataFrame operations only.

Base kinds are found by pattern: e-mail and IP addresses, card and phone numbers; a match that
fails its check (parts, digits, Luhn) is dropped. A found value is a protected entity; so are the
domain and the local part of an e-mail address, which pool what their single addresses are too rare
for. All words of a text that holds an entity are candidates, and the corpus says what each reveals:

* P(e|t), the chance that a text with term t holds entity e, is taken at its lower confidence bound
  (Wilson, ``z`` deviations), so one text is no evidence however rare its words are. The bound is the
  score; where it reaches ``threshold`` the term leaves at most -log2(threshold) bits of the entity
  open and discloses it. It does not depend on how large the table is.
* Copies of a text are one witness. The number of observations behind the bound is the effective
  number of contexts (``context`` words on each side) that t stands in: n * n over the sum of squares of
  how often each occurs, about 1 for a term that only copies, exact or near, of one text hold.
* Chance is ruled out: if t had nothing to do with e, k texts with both would be a coincidence of
  -k * log2 P(e) bits, of which ``evidence`` are asked for.

Wherever a disclosing term stands it is generalised to its class (a name, a word of the kind that it
discloses), or removed from a score of ``remove`` on.

Counts and hits are shuffled, not texts. Places are added up along a text within its row; the words
of the corpus are counted with a sum in each task before the shuffle; entities that too few texts hold
to matter are left out before words are paired with them; terms are looked for by a broadcast of at
most ``broadcast_terms`` rows, beyond that by a bitmap of their hashes (8 MB whatever their number)
that lets few other words through to an exact join.

The patterns never back up: runs of a class are taken whole and a match starts where a run starts,
which finds what the plain patterns find and stays linear in the text.

Defined results: a null text counts as empty and has no spans; a text of any length is read whole;
repeated rows, rows without an id and rows that share an id get results of their own, equal ones for
equal texts; spans of different kinds may overlap, each is listed, and ``sanitise`` cuts overlapping
ones as one with the mark of the first; of terms that disclose several kinds the largest share
counts, then the kind that comes first by name; an empty table gives an empty result;
``find_personal_data`` returns its own columns only, ``sanitise`` all columns of ``docs`` whatever
their names.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.words import lower_az
from seqloom.storage import stored

#: Kind, a test that is cheap and lets every match through, pattern.
BASE_KINDS = (
    ("email", r"@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", r"[0-9][\x20-]?[0-9]", r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+"),
    ("phone", r"\+[0-9]", r"\+[0-9](?:[\x20().-]*+[0-9])++"),
)
KIND_ORDER = ("email", "ip", "card", "phone", "term")
TERM = r"\p{L}++"
SPANS = "array<struct<start: bigint, end: bigint, value: string>>"
PLACES = "array<struct<start: bigint, end: bigint, term: string>>"
#: Bits of the bitmap of term hashes, and of one of its rows.
BITMAP, BITMAP_ROW = 1 << 26, 1 << 15


@dataclass(frozen=True)
class DisclosureParams:
    """The meaning of each is in the module's text. ``broadcast_terms``: most terms, or texts with terms, that are broadcast."""

    z: float = 1.0
    threshold: float = 0.6
    remove: float = 0.9
    evidence: float = 12.0
    context: int = 3
    broadcast_terms: int = 200_000

    @property
    def least(self) -> int:
        """Texts that a term and an entity must share at least: fewer can't reach the threshold."""
        return max(1, math.ceil(self.threshold * self.z**2 / (1 - self.threshold)))


def lower_bound(k: Column, n: Column, seen: Column, z: float) -> Column:
    """Wilson's lower bound of a share of k in n, for ``seen`` observations."""
    share = k / n
    spread = F.sqrt(share * (1 - share) / seen + z * z / (4 * seen * seen))
    return (share + z * z / (2 * seen) - z * spread) / (1 + z * z / seen)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn test."""
    turned = F.reverse(_digits(value))
    doubled = lambda i: F.substring(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), lambda s, i: s + F.when(doubled(i) > 9, doubled(i) - 9).otherwise(doubled(i)))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    """Whether a match of a kind's pattern passes its check."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: (F.length(F.regexp_replace(x, "^0+", "")) <= 3) & (F.coalesce(F.right(x, F.lit(4)).cast("int"), F.lit(0)) <= 255))
    n = F.length(_digits(value))
    if kind == "card":
        return n.between(12, 19) & F.when(n <= 19, _luhn(value))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _places(text: Column, pattern: str, schema: str, wanted, made) -> Column:
    """Of the matches of ``pattern`` those for which ``wanted(match)`` holds, as ``made(start, end, match, before, after)``.

    Places are code points, added up along the text; before and after are the texts up to the next match.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("before"), F.slice(gaps, F.lit(2), F.size(hits)).alias("after"), hits.alias("value"))
    state = f"struct<at: bigint, out: {schema}>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["value"])
        out = F.when(wanted(x["value"]), F.concat(acc["out"], F.array(made(start, end, x["value"], x["before"], x["after"])).cast(schema))).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out")).cast(state)

    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(schema).alias("out")).cast(state)
    return F.aggregate(steps, zero, step, lambda acc: acc["out"])


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def _base(text: Column) -> dict[str, Column]:
    """For each kind its valid matches as ``SPANS``."""
    made = lambda start, end, value, *_: F.struct(start.alias("start"), end.alias("end"), value.alias("value"))
    none = F.array().cast(SPANS)
    return {kind: F.when(text.rlike(cheap), _places(text, pattern, SPANS, lambda v, k=kind: _valid(k, v), made)).otherwise(none) for kind, cheap, pattern in BASE_KINDS}


def base_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its number, id, print (a hash of the text), for each kind an array of (start, end, value), and where there is any the different words of the text around them. Stored."""
    text = _text(text_col)
    found = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("print"), text.alias("text"), *[c.alias(kind) for kind, c in _base(text).items()])
    some = F.expr(" or ".join(f"size({k}) > 0" for k, _, _ in BASE_KINDS))
    beside = F.regexp_replace("text", BASE_KINDS[0][2], " ")  # only addresses have words of their own
    return stored(found.withColumn("beside", beside).withColumn("words", F.when(some, F.array_distinct(_words("beside")))).drop("text", "beside"))


def _entities(x: Column, kind: str) -> Column:
    """The entities of a match: its value, and of an address the local part and the domain."""
    value = _digits(x["value"]) if kind in ("card", "phone") else F.lower(x["value"])
    groups = [F.concat(F.lit("local:"), F.split(value, "@")[0]), F.concat(F.lit("domain:"), F.split(value, "@")[1])] if kind == "email" else []
    return F.transform(F.array(F.concat(F.lit(f"{kind}:"), value), *groups), lambda e: F.struct(e.alias("entity"), F.lit(kind).alias("kind")))


def disclosing_terms(base: DataFrame, docs: DataFrame, p: DisclosureParams = DisclosureParams(), text_col: str = "text", id_col: str = "doc_id") -> DataFrame | None:
    """(term, part, kind): terms that disclose an entity, the score of the one they reveal most and that entity's kind; stored; None if there is none. ``base`` as from ``base_spans``."""
    total = float(max(base.count(), 1))
    of_kind = lambda kind: F.transform(kind, lambda x: _entities(x, kind))
    every = F.array_distinct(F.flatten(F.concat(*[of_kind(k) for k, _, _ in BASE_KINDS])))
    held = base.filter("words is not null").select("row", F.explode(every).alias("x")).select("row", "x.*")
    surprise = lambda n: -F.log2(F.least(F.lit(0.5), n / F.lit(total)))
    often = held.groupBy("entity").agg(F.count("*").alias("n_e")).filter((F.col("n_e") >= p.least) & (F.col("n_e") * surprise(F.col("n_e")) >= p.evidence))
    # an entity stands for itself by a hash from here on; its rows are short, its words join only row by row
    of_row = held.join(often, "entity").groupBy("row").agg(F.collect_list(F.struct(F.xxhash64("entity").alias("e"), "kind", "n_e")).alias("entities"))
    pairs = base.select("row", "words").join(of_row, "row").select("entities", F.explode("words").alias("term")).select("term", F.explode("entities").alias("x"))
    shared = pairs.groupBy("term", "x.e", "x.kind", "x.n_e").agg(F.count("*").alias("k")).filter(F.col("k") >= p.least)
    best = stored(shared.filter(F.col("k") * surprise(F.col("n_e")) >= p.evidence).groupBy("term", "kind").agg(F.max("k").alias("k"), F.max_by("n_e", "k").alias("n_e")))
    if best.isEmpty():
        return None
    # every row's different words, summed in each task before the shuffle
    spread = docs.select(F.explode(F.array_distinct(_words(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    gained = F.col("k") * F.lit(total) >= 2 * F.col("n_t") * F.col("n_e")  # at least twice as likely as without the term
    likely = stored(best.join(spread, "term").filter((F.col("k") >= p.threshold * F.col("n_t")) & gained).select("term", "kind", "k", "n_t"))
    if likely.isEmpty():
        return None
    seen = _contexts(docs, likely.select("term").distinct(), p, text_col, id_col)
    scored = likely.join(seen, "term").select("term", "kind", lower_bound(F.col("k"), F.col("n_t"), F.col("seen"), p.z).alias("part")).filter(F.col("part") >= p.threshold)
    found = stored(scored.groupBy("term").agg(F.max("part").alias("part"), F.min_by("kind", F.struct(-F.col("part"), F.col("kind"))).alias("kind")))
    return None if found.isEmpty() else found


def _contexts(docs: DataFrame, terms: DataFrame, p: DisclosureParams, text_col: str, id_col: str) -> DataFrame:
    """(term, seen): the effective number of contexts in which each term first stands in a text."""
    words, c = F.col("words"), p.context
    here = _texts(docs, _rows_holding(docs, terms, p, text_col, id_col), p, text_col, id_col).select("terms", _words("text").alias("words"))
    at = F.array_position(words, F.col("term"))
    around = F.slice(words, F.greatest(F.lit(1), at - c).cast("int"), (F.least(at, F.lit(c + 1)) + c).cast("int"))
    rows = here.select("words", F.explode(F.transform("terms", lambda x: x["term"])).alias("term")).select("term", F.xxhash64(around).alias("context"))
    times = rows.groupBy("term", "context").agg(F.count("*").cast("double").alias("c"))
    return times.groupBy("term").agg((F.sum("c") * F.sum("c") / F.sum(F.col("c") * F.col("c"))).alias("seen"))


def _words(text_col: str) -> Column:
    return F.regexp_extract_all(lower_az(_text(text_col)), F.lit(TERM), F.lit(0))


def _bitmap(terms: DataFrame) -> DataFrame:
    """(row, bits): at most BITMAP / BITMAP_ROW rows of BITMAP_ROW bits, in which the hash of every term is set."""
    at = F.pmod(F.xxhash64("term"), F.lit(BITMAP))
    return stored(terms.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")))


def _holding(words: DataFrame, terms: DataFrame, p: DisclosureParams) -> DataFrame:
    """The rows of ``words`` whose ``term`` is in ``terms``, with its columns."""
    if terms.count() <= p.broadcast_terms:
        return words.join(F.broadcast(terms), "term")
    at = F.pmod(F.xxhash64("term"), F.lit(BITMAP))
    marked = words.withColumn("b_row", F.bitmap_bucket_number(at)).withColumn("b_at", F.bitmap_bit_position(at))
    byte = F.conv(F.hex(F.substring("bits", (F.expr("b_at div 8") + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    passed = marked.join(F.broadcast(_bitmap(terms).withColumnRenamed("row", "b_row")), "b_row").filter(F.getbit(byte, F.pmod(F.col("b_at"), F.lit(8)).cast("int")) == 1)
    return passed.drop("b_row", "b_at", "bits").join(terms, "term")


def _rows_holding(docs: DataFrame, terms: DataFrame, p: DisclosureParams, text_col: str, id_col: str) -> DataFrame:
    """(h_id, h_print, terms): ids and prints of the texts that hold any of ``terms``, and which; stored."""
    words = docs.select(F.col(id_col).alias("h_id"), F.xxhash64(_text(text_col)).alias("h_print"), F.explode(F.array_distinct(_words(text_col))).alias("term"))
    return stored(_holding(words, terms, p).groupBy("h_id", "h_print").agg(F.collect_set(F.struct(*terms.columns)).alias("terms")))


def _texts(docs: DataFrame, held: DataFrame, p: DisclosureParams, text_col: str, id_col: str) -> DataFrame:
    """(id, print, text, terms): the rows of ``docs`` that ``held`` names; equal rows stay as many as they are."""
    few = held.count() <= p.broadcast_terms
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(_text(text_col)).alias("print"), _text(text_col).alias("text"))
    return texts.join(F.broadcast(held) if few else held, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("print") == F.col("h_print"))).drop("h_id", "h_print")


def texts_with_terms(docs: DataFrame, terms: DataFrame, p: DisclosureParams = DisclosureParams(), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, print, terms, places): the rows with disclosing terms, those terms (term, part, kind) and where they stand; stored, one row for each id and text."""
    held = _texts(docs, _rows_holding(docs, terms, p, text_col, id_col), p, text_col, id_col)
    names = F.transform("terms", lambda x: x["term"])
    places = _places(lower_az(F.col("text")), TERM, PLACES, lambda v: F.array_contains(names, v), lambda start, end, v, *_: F.struct(start.alias("start"), end.alias("end"), v.alias("term")))
    return stored(held.select("id", "print", "terms", places.alias("places")).dropDuplicates(["id", "print"]))


def find_personal_data(docs: DataFrame, p: DisclosureParams = DisclosureParams(), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: id, counts by kind, base_sha256, spans and n_term."""
    base = base_spans(docs, text_col, id_col)
    terms = disclosing_terms(base, docs, p, text_col, id_col)
    ranked = lambda c, i: F.transform(c, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("rank"), x["end"].alias("end")))
    kinds = [k for k, _, _ in BASE_KINDS]
    rows = base.withColumn("found", F.concat(*[ranked(k, i) for i, k in enumerate(kinds)]))
    if terms is None:
        rows = rows.withColumn("places", F.array().cast(PLACES))
    else:
        places = texts_with_terms(docs, terms, p, text_col, id_col).select(F.col("id").alias("t_id"), F.col("print").alias("t_print"), "places")
        rows = rows.join(places, F.col("id").eqNullSafe(F.col("t_id")) & (F.col("print") == F.col("t_print")), "left").withColumn("places", F.coalesce("places", F.array().cast(PLACES)))
    listed = lambda xs: F.array_join(F.transform(F.array_sort(xs), lambda x: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KIND_ORDER]), x["rank"] + 1), x["start"], x["end"])), ",")
    return rows.select(
        F.col("id").alias(id_col), *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds], F.sha2(listed(F.col("found")).cast("binary"), 256).alias("base_sha256"),
        listed(F.concat("found", ranked("places", len(kinds)))).alias("spans"), F.size("places").cast("long").alias("n_term"),
    )


def sanitise(docs: DataFrame, p: DisclosureParams = DisclosureParams(), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with every base match replaced by its kind in brackets, and every disclosing term by its class or removed; columns as they were."""
    base = base_spans(docs, text_col, id_col)
    terms = disclosing_terms(base, docs, p, text_col, id_col)
    own = f"s{uuid.uuid4().hex}_"  # no column of a caller has this name
    text = _text(text_col)
    mark = "struct<start: bigint, end: bigint, rank: int, mark: string>"

    def base_cut(kind: str, rank: int, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(x["start"], x["end"], F.lit(rank), F.lit(f"[{kind.upper()}]")).cast(mark))

    cuts = F.concat(*[base_cut(kind, i, c) for i, (kind, c) in enumerate(_base(text).items())])
    if terms is not None:
        with_terms = texts_with_terms(docs, terms, p, text_col, id_col)
        few = with_terms.count() <= p.broadcast_terms
        side = with_terms.select(F.col("id").alias(f"{own}id"), F.col("print").alias(f"{own}print"), F.col("terms").alias(f"{own}terms"), F.col("places").alias(f"{own}places"))
        docs_ = docs.join(F.broadcast(side) if few else side, F.col(id_col).eqNullSafe(F.col(f"{own}id")) & (F.xxhash64(text) == F.col(f"{own}print")), "left")

        def term_cut(x: Column) -> Column:
            about = F.filter(f"{own}terms", lambda t: t["term"] == x["term"])[0]
            name = F.when(F.substring(text, (x["start"] + 1).cast("int"), F.lit(1)).rlike(r"\p{Lu}"), "NAME").otherwise("WORD")
            shown = F.when(about["part"] >= p.remove, F.lit("")).otherwise(F.concat(F.lit("["), name, F.lit(":"), F.upper(about["kind"]), F.lit("]")))
            return F.struct(x["start"], x["end"], F.lit(len(BASE_KINDS)), shown).cast(mark)

        cuts = F.concat(cuts, F.coalesce(F.transform(f"{own}places", term_cut), F.array().cast(f"array<{mark}>")))
    else:
        docs_ = docs
    state = "struct<upto: bigint, out: array<string>>"

    def step(acc: Column, x: Column) -> Column:
        between = F.substring(text, (acc["upto"] + 1).cast("int"), (x["start"] - acc["upto"]).cast("int"))
        inside = x["start"] < acc["upto"]  # of an overlap: already cut
        out = F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(between, x["mark"])))
        return F.struct(F.greatest(acc["upto"], x["end"]).alias("upto"), out.alias("out")).cast(state)

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["upto"] + 1).cast("int"), F.lit(2**31 - 1)))
    zero = F.struct(F.lit(0).cast("bigint").alias("upto"), F.array().cast("array<string>").alias("out")).cast(state)
    clean = F.when(F.size(f"{own}cuts") > 0, F.aggregate(F.array_sort(f"{own}cuts"), zero, step, rest)).otherwise(F.col(text_col))
    marked = docs_.withColumn(f"{own}cuts", cuts)
    return marked.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
