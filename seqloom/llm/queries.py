"""The queries opN_<name>: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.backoff_lm import score_texts
from seqloom.llm.bpe import encode_texts
from seqloom.llm.collocations import mine_collocations
from seqloom.llm.cross_polytope import near_vectors
from seqloom.llm.disclosure import find_personal_data
from seqloom.llm.mixing import mix
from seqloom.llm.packing import pack
from seqloom.llm.pu_quality import score_quality, train
from seqloom.llm.quality_rules import quality_rules
from seqloom.llm.role_repair import repair_roles
from seqloom.llm.set_sketch import near_duplicates
from seqloom.llm.turn_repair import damaged, repair_report
from seqloom.llm.url_filter import filter_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The tokenizer of the queries on tokens; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_pack_nnls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of 2048-token sequences."""
    return pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op1_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.9 and more among all embeddings, and each vector's class."""
    return near_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op3_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learnt from good labels of the training fold and unlabelled text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, train(docs, _table(spark, sf_dir, "labels")))


def op4_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all sources by weight takes of every document."""
    return mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op5_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log10 probability of every document."""
    return score_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with its repaired role and its part of the formatted conversation."""
    return repair_roles(_table(spark, sf_dir, "conversations"))


def op7_url_char_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule or the model's verdict for every page."""
    return filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"))


def op8_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, and the terms that disclose it."""
    return find_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    return quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_set_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near copies that each document belongs to."""
    return near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_bpe_speculate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digests of every document's ids and of the text that they decode to."""
    coded = encode_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    n_tokens = F.expr("octet_length(ids) div 4")
    return coded.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, once its rows are damaged."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report = repair_report(damaged(turns))
    every = turns.groupBy(F.col("conv_id").alias("_id")).agg(F.count("*").alias("_n"))
    out = every.join(report, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return out.select(F.col("_id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def op13_quotient_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of two and three words of each language."""
    return mine_collocations(_table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {f.__name__: f for f in (op1_cross_polytope, op2_pack_nnls, op3_pu_quality, op4_entropy_mix, op5_backoff_lm, op6_role_repair, op7_url_char_lm, op8_disclosure_pii, op9_quality_rules, op10_set_sketch_dedup, op11_bpe_speculate, op12_turn_repair, op13_quotient_phrases)}

ORACLE_SQL: dict[str, str] = {
    "op13_quotient_phrases": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        runs AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        words AS (SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM runs),
        ahead AS (SELECT lang, w1, lead(w1) OVER piece AS w2, lead(w1, 2) OVER piece AS w3 FROM words WINDOW piece AS (PARTITION BY piece ORDER BY i)),
        f1 AS MATERIALIZED (SELECT lang, w1, count(*)::HUGEINT AS f FROM ahead GROUP BY ALL),
        f2 AS MATERIALIZED (SELECT lang, w1, w2, count(*)::HUGEINT AS f FROM ahead WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        f3 AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*)::HUGEINT AS f FROM ahead WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
        inside AS (SELECT lang, w1, w2, max(f) AS longer FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
        twos AS (
            SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, x.f AS l, y.f AS r, 1 AS cut
            FROM f2 t JOIN f1 x ON x.lang = t.lang AND x.w1 = t.w1 JOIN f1 y ON y.lang = t.lang AND y.w1 = t.w2
            LEFT JOIN inside z ON z.lang = t.lang AND z.w1 = t.w1 AND z.w2 = t.w2 WHERE longer IS NULL OR 100 * longer < 50 * t.f),
        threes AS (
            SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.f AS a, x.f AS l, y.f AS r, 1 AS cut
            FROM f3 t JOIN f1 x ON x.lang = t.lang AND x.w1 = t.w1 JOIN f2 y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
            UNION ALL
            SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, x.f, y.f, 2
            FROM f3 t JOIN f2 x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN f1 y ON y.lang = t.lang AND y.w1 = t.w3),
        scored AS (SELECT *, (1000000 * a * a) // (l * r) AS score FROM (SELECT * FROM twos UNION ALL SELECT * FROM threes)),
        kept AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
        FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
}
