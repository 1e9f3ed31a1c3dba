"""The operators of this package applied to whole tables, and the same questions in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.llm import ctw, decontam, exact, extract, jaccard, kneser, licenses, materialise, mixing, negatives, outliers, runs, suffix
from diffloom.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.context_tree_scores(_table(spark, sf_dir, "documents"))


def op2_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_pages(_table(spark, sf_dir, "pages"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_links(_table(spark, sf_dir, "documents"), shingle_words=4, percent=85)


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(_table(spark, sf_dir, "documents"), licenses.default_templates(spark))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise.written_in_lots(_table(spark, sf_dir, "documents"), scratch_path(spark, "shards"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_passages(_table(spark, sf_dir, "documents"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """Every tenth text by the CRC of its doc_id continues, from some word on, in repetitions of the words from there."""
    code = F.crc32(F.col("doc_id").cast("string"))
    number = F.floor(code / 10).cast("bigint")

    def tailed(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        at = number % F.greatest(n, F.lit(1))
        period = F.floor((n - at) / (number % 8 + 3)).cast("bigint") + 1
        return F.array_join(F.transform(words, lambda word, i: F.when(i < at, word).otherwise(
            F.get(words, (at + (i - at) % period).cast("int")))), " ")

    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # A one-element array binds the words, so that they are split once.
    tail = F.get(F.transform(F.array(words), tailed), F.lit(0))
    return docs.select("doc_id", F.when(code % 10 == 0, tail).otherwise(F.col("text")).alias("text"))


def op11_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_periodic_tails(_table(spark, sf_dir, "documents")))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    longer = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    # Runs come by start, then period, so the first of equal exponents stays.
    best = F.aggregate("runs", none, lambda kept, r: F.when(kept.isNull() | longer(r, kept), r).otherwise(kept))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"),
        F.col("_best.start").alias("start"), F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = outliers.quality_rules(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *outliers.STATISTICS, "base_failed", "kept")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_context_tree": op1_context_tree,
    "op2_text_density": op2_text_density,
    "op3_source_mix": op3_source_mix,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_kneser_ney": op5_kneser_ney,
    "op6_license_scan": op6_license_scan,
    "op7_decontamination": op7_decontamination,
    "op8_training_order": op8_training_order,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_period_runs": op11_period_runs,
    "op12_robust_outliers": op12_robust_outliers,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op9_exact_dedup": """
        WITH normal AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
            FROM documents
        ), grouped AS (
            SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM normal GROUP BY body
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
        FROM normal JOIN grouped USING (body)
    """,
    "op13_hard_negatives": """
        WITH fit AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, r.vec_id AS vec_id, a.label = r.label AS same,
                   CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.v, r.v)]) AS BIGINT) AS score
            FROM fit a JOIN fit r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id
        ), positive AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        ), window_rows AS (
            SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
                   CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
            FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
             AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
        )
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM window_rows WHERE rank <= 3
    """,
}
