"""A training-data pipeline over ``documents``: five stages, each one operator of ``diffloom.llm``.

Every stage reads what its predecessor wrote, and its decisions take effect: rejected rows, all but
one row of a near-duplicate group and contaminated rows go; the mix repeats and cuts texts;
the last stage puts the tokens of what is left into training order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.llm import decontam, jaccard, kneser, materialise, mixing
from diffloom.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows whose perplexity the classifier accepts, in one pass over their texts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = kneser.quality_decisions(docs, labels, [c for c in COLUMNS if c != "text"])
    return scores.where("accepted").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of rows that share 80 % of their five-word shingles: the first by doc_id, then by text."""
    return jaccard.without_copies(docs, shingle_words=5, percent=80).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = decontam.contaminated(docs, benchmark)
    kept = docs.join(hits.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)
    nameless = docs.where("doc_id is null")
    if nameless.isEmpty():
        return kept
    # Rows without a doc_id are told apart by their text.
    keyed = nameless.withColumn("_key", F.xxhash64("text"))
    found = decontam.contaminated(keyed.select(F.col("_key").alias("doc_id"), "text"), benchmark)
    clean = keyed.join(found.select(F.col("doc_id").alias("_key")).distinct(), "_key", "left_anti").select(*COLUMNS)
    return kept.where("doc_id is not null").unionByName(clean)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as often as the mix takes them: whole passes as rows of their own, and the words of chosen blocks."""
    return mixing.mixed_texts(docs).select(*COLUMNS)


def training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the shards to the shared folder; one row for each slot with its place and documents."""
    return materialise.written_in_lots(docs, scratch_path(spark, "shards"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("token-ID output", training_order),
]

#: The classifier, the product and the tokenizer have no SQL form; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.split()[0])
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
