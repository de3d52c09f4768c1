"""URL filter by rules and a character language-model ratio, with DataFrame operations only.

Rules on host and path decide first; the longest rule that fits wins. They also label the training
URLs: two smoothed variable-order Markov models of characters are counted, one over accepted and
one over rejected URLs. URLs that fold alike are one row, which counts as often as they stand in the
table, in the models and in the calibration. A URL that no rule fits is judged by the difference of its two
log-likelihoods, divided by its length, against a limit that is calibrated on labelled URLs held
out by hash.

The models are of variable order: a context is up to ``context`` characters, and every n-gram of the
labelled URLs is in the model, however seldom it stands and however many there are. Counts are over
the whole table. An n-gram's probability mixes its count with that of the next shorter context by
Witten and Bell, (c + t * lower) / (n + t); of an n-gram that neither class holds the context's share
t / (n + t) is carried over to the shorter one, for each class its own, so both models sum to one over
the symbols.

What a character adds depends on its longest n-gram alone, so this is worked out once for each
different n-gram of the URLs to score, by joins of any size. The URLs' characters then meet the most
frequent of these, at most ``broadcast_grams``, by broadcast and all others by shuffle; a key that is
shuffled is rare by that choice. What the characters add is summed as decimals, the same in any order.

Defined results: a null URL, or one without ``://``, has empty host and path and no rule fits it; a
null or empty URL has ratio 0; a URL of any length is read whole; repeated rows, and rows without an
id, are judged one by one; of rules that fit and are as long the one first by text wins; without URLs
of both kinds to learn from everything that no rule fits is allowed, with too few to hold some out
the limit is 0; of limits that part the held-out URLs equally well the middle one is taken; an empty
table gives an empty result; only the operator's own columns are returned, whatever others ``pages`` has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.words import UPPER
from seqloom.storage import stored

#: Rules as (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: a-z, the digits as one, ten marks, all else as one, and the start of a URL.
SYMBOLS = 26 + 1 + 10 + 1 + 1
START, OTHER, DIGIT = "^", "~", "0"
MARKS = "/.-_?=&%#:"


@dataclass(frozen=True)
class UrlParams:
    """``context``: longest context in characters. ``broadcast_grams``: most n-grams that are broadcast; more are joined by shuffle. ``held``: of ``folds`` hashed parts the one that calibrates. ``bins``: score bins of the calibration.

    ``most_grams``: only for a caller who wants a smaller, other model: it keeps the n-grams that stand at least as often as the least power of two that leaves so many. None, as in the query, keeps all.
    """

    context: int = 5
    most_grams: int | None = None
    broadcast_grams: int = 150_000
    folds: int = 5
    held: int = 0
    bins: int = 400
    span: float = 4.0
    rules: tuple = RULES


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def judge_by_rules(host: Column, path: Column, rules: tuple) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does. Longer host, then longer path, counts as longer in all."""
    rule = verdict = None
    for what, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return rule, verdict


def folded(url: Column) -> Column:
    """The URL over the model's symbols."""
    low = F.lower(F.coalesce(url, F.lit("")))
    return F.regexp_replace(F.regexp_replace(low, "[0-9]", DIGIT), r"[^a-z0/.\-_?=&%#:]", OTHER)


def _grams(rows: DataFrame, context: int) -> DataFrame:
    """One row a character: the columns of ``rows``, ctx (the characters before it) and sym."""
    padded = F.concat(F.lit(START * context), F.col("folded"))
    at = F.sequence(F.lit(1), F.length("folded"))
    spots = F.when(F.length("folded") > 0, F.transform(at, lambda i: F.substring(padded, i, F.lit(context + 1))))
    return rows.withColumn("gram", F.explode(spots)).withColumn("ctx", F.substring("gram", 1, context)).withColumn("sym", F.substring("gram", context + 1, 1))


def _octave(n: Column | str) -> Column:
    return F.floor(F.log2(n)).cast("int")


def _least_octave(table: DataFrame, n: Column | str, most: int) -> int:
    """The least octave of ``n`` from which on ``table`` has at most ``most`` rows."""
    sizes = {r["octave"]: r["rows"] for r in table.groupBy(_octave(n).alias("octave")).agg(F.count("*").alias("rows")).collect()}  # at most 64 rows
    least, rows = 0, sum(sizes.values())
    while rows > most:
        rows -= sizes.get(least, 0)
        least += 1
    return least


def _counted(labelled: DataFrame, p: UrlParams) -> DataFrame:
    """(gram, a, b): the n-grams of all orders and how often allowed and blocked URLs hold each; stored."""
    times = lambda verdict: F.sum(F.when(F.col("verdict") == verdict, F.col("times")).otherwise(0))
    longest = stored(_grams(labelled.select("folded", "verdict", "times"), p.context).groupBy("gram").agg(times("allow").alias("a"), times("block").alias("b")))
    # lower orders are sums over the longest, so the text is read once
    every = longest.select("*")
    for k in range(p.context):
        every = every.unionByName(longest.groupBy(F.right("gram", F.lit(k + 1)).alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    every = stored(every)
    if p.most_grams is None:
        return every
    both = F.col("a") + F.col("b")
    return stored(every.filter(_octave(both) >= _least_octave(every, both, p.most_grams)))


def language_models(labelled: DataFrame, p: UrlParams = UrlParams()) -> tuple[dict[int, DataFrame], dict[int, DataFrame], float]:
    """By order k: (gram, ratio), log10 of P(sym | ctx) among allowed over that among blocked for each n-gram with k characters of context,
    and (ctx, back), that of the shares that contexts of k > 0 characters leave to shorter ones; last that of the empty context. Tables are stored.

    ``labelled`` has folded, verdict and times, how many rows of the table it stands for.
    """
    counted = _counted(labelled, p)
    grams, backs, prob, empty = {}, {}, None, 0.0
    for k in range(p.context + 1):
        own = counted.filter(F.length("gram") == k + 1).withColumn("ctx", F.substring("gram", 1, k) if k else F.lit("")).withColumn("tail", F.right("gram", F.lit(k)))
        totals = own.groupBy("ctx").agg(*[f(c).alias(n + c) for c in "ab" for n, f in (("n", F.sum), ("t", lambda c: F.count_if(F.col(c) > 0)))])
        share = lambda c: F.when(F.col(f"n{c}") > 0, F.col(f"t{c}") / (F.col(f"n{c}") + F.col(f"t{c}"))).otherwise(1.0)
        mixed = lambda c, lower: F.when(F.col(f"n{c}") > 0, (F.col(c) + F.col(f"t{c}") * lower) / (F.col(f"n{c}") + F.col(f"t{c}"))).otherwise(lower)
        back = totals.select("ctx", (F.log10(share("a")) - F.log10(share("b"))).alias("back"))
        if k:
            backs[k] = stored(back)
            lower = prob.select(F.col("gram").alias("tail"), F.col("pa").alias("la"), F.col("pb").alias("lb"))
            own = own.join(totals, "ctx").join(lower, "tail").select("gram", mixed("a", F.col("la")).alias("pa"), mixed("b", F.col("lb")).alias("pb"))
        else:
            empty = next((r["back"] for r in back.collect()), 0.0)  # one row
            uniform = F.lit(1.0 / SYMBOLS)
            own = own.join(totals, "ctx").select("gram", mixed("a", uniform).alias("pa"), mixed("b", uniform).alias("pb"))
        prob = stored(own)
        grams[k] = prob.select("gram", (F.log10("pa") - F.log10("pb")).alias("ratio"))
    return grams, backs, empty


def _gram_ratios(asked: DataFrame, model: tuple[dict[int, DataFrame], dict[int, DataFrame], float], p: UrlParams) -> DataFrame:
    """Adds ratio, what the last character of the n-gram adds, to ``asked``, whose gram are different longest n-grams."""
    grams, backs, empty = model
    asked = asked.withColumn("ratio", F.lit(empty))
    for k in range(p.context + 1):
        if k:
            side = backs[k].select(F.col("ctx").alias("of"), "back")
            asked = asked.join(side, F.substring("gram", p.context - k + 1, k) == F.col("of"), "left").withColumn("ratio", F.coalesce("back", F.lit(0.0)) + F.col("ratio"))
        side = grams[k].select(F.col("gram").alias("end"), F.col("ratio").alias("known"))
        asked = asked.select("gram", "spots", "ratio").join(side, F.right("gram", F.lit(k + 1)) == F.col("end"), "left").select("gram", "spots", F.coalesce("known", "ratio").alias("ratio"))
    return asked.withColumn("ratio", F.col("ratio").cast("decimal(18,15)"))


def _ratios(rows: DataFrame, model: tuple[dict[int, DataFrame], dict[int, DataFrame], float], p: UrlParams) -> DataFrame:
    """(url_no, ratio): the length-normalised difference of log-likelihoods; no row for an empty URL. ``rows`` are url_no and folded."""
    spots = _grams(rows, p.context).select("url_no", "gram")
    asked = stored(_gram_ratios(stored(spots.groupBy("gram").agg(F.count("*").alias("spots"))), model, p))
    least = _least_octave(asked, "spots", p.broadcast_grams)
    often = F.broadcast(asked.filter(_octave("spots") >= least).select("gram", "ratio"))  # at most broadcast_grams rows
    added = spots.join(often, "gram")
    if least:
        seldom = asked.filter(_octave("spots") < least).select("gram", "ratio")
        added = added.unionByName(spots.join(often, "gram", "left_anti").join(seldom, "gram"))
    return added.groupBy("url_no").agg((F.sum("ratio").cast("double") / F.count("*")).alias("ratio"))


def filter_urls(pages: DataFrame, p: UrlParams = UrlParams(), url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, ratio (null where a rule decides)."""
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"), folded(F.col(url_col)).alias("folded"))
    rule, verdict = judge_by_rules(F.col("host"), F.col("path"), p.rules)
    rows = rows.withColumn("rule", rule).withColumn("verdict", verdict)
    urls = stored(rows.groupBy("folded", "verdict").agg(F.count("*").alias("times")).withColumn("url_no", F.monotonically_increasing_id()))
    labelled = urls.filter("verdict is not null")
    out_of = F.pmod(F.xxhash64("folded"), F.lit(p.folds)) == p.held
    model = language_models(labelled.filter(~out_of), p)
    # written before the join with the rows, so that a URL that very many rows share can be dealt to several tasks
    asked = urls.filter(F.col("verdict").isNull() | out_of)
    scored = stored(asked.join(_ratios(asked.select("url_no", "folded"), model, p), "url_no"))
    # calibration: the limit that parts held-out allowed and blocked URLs best, by balanced accuracy over score bins
    low = -p.span
    bin_ = F.greatest(F.lit(0), F.least(F.lit(p.bins - 1), F.floor((F.col("ratio") - low) / (2 * p.span) * p.bins)))
    hist = scored.filter("verdict is not null").groupBy(bin_.alias("bin"), "verdict").agg(F.sum("times").alias("k")).collect()  # at most two rows a bin
    allow, block = [0] * p.bins, [0] * p.bins
    for r in hist:
        (allow if r["verdict"] == "allow" else block)[r["bin"]] += r["k"]
    limit = calibrated_limit(allow, block, low, 2 * p.span / p.bins)
    if limit is None and labelled.select("verdict").distinct().count() == 2:
        limit = 0.0  # too few labelled URLs to hold any out: even odds
    ratios = scored.filter("verdict is null").select("folded", "ratio")
    ruled = rows.filter("verdict is not null").withColumn("ratio", F.lit(None).cast("double"))
    bare = rows.filter("verdict is null and folded = ''").withColumn("ratio", F.lit(0.0))
    judged = rows.filter("verdict is null and folded <> ''").join(ratios, "folded").unionByName(bare)
    method = F.when(F.lit(limit is None) | (F.col("ratio") >= F.lit(limit if limit is not None else 0.0)), "allow").otherwise("block")
    return ruled.unionByName(judged.withColumn("verdict", method)).select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "ratio")


def calibrated_limit(allow: list[int], block: list[int], low: float, width: float) -> float | None:
    """The lower edge of the first bin to allow; in the middle of the best stretch. None if a class is missing."""
    a, b = sum(allow), sum(block)
    if not a or not b:
        return None
    below_a = below_b = 0
    gains = []
    for x, y in zip(allow, block, strict=True):
        gains.append(below_b / b + (a - below_a) / a)
        below_a, below_b = below_a + x, below_b + y
    best = [i for i, g in enumerate(gains) if g >= max(gains) - 1e-12]
    return low + width * best[len(best) // 2]
