"""Exact deduplication by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom.session import checkpointed

HOT = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; null as the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def exact_duplicates(docs: DataFrame, salts: int = 16) -> DataFrame:
    """Every row with the row that stays of its group of equal texts.

    Texts are equal when they are identical after lower-casing A-Z. Three stages
    compare whole texts, never digests alone: each task folds its own equal texts
    (the partial aggregation), salted digest groups fold what tasks send, and the salt
    winners of a digest are folded at last. A group that holds a third of all rows
    reaches the first exchange as one row for each task and the second as one row for
    each salt. Only small rows without text go back to the documents; should two
    different texts ever share a digest, the job stops instead of giving a wrong answer.

    Null texts count as empty, so they form one group with empty texts. Null doc_ids
    never win over a number. Repeated rows count in ``group_size``; rows with the
    winner's doc_id are all ``kept``. An empty table gives no rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), lowered(F.col("text")).alias("_norm")
    ).withColumn("text_sha256", F.sha2("_norm", 256))
    digest = F.unhex("text_sha256")
    salted = (
        rows.select("doc_id", "_norm", digest.alias("_digest"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt"))
        .groupBy("_digest", "_norm", "_salt")
        .agg(F.max("doc_id").alias("_win"), F.count(F.lit(1)).alias("_n"))
    )
    classes = salted.groupBy("_digest", "_norm").agg(F.max("_win").alias("keep_id"), F.sum("_n").alias("group_size"))
    by_digest = checkpointed(
        classes.groupBy("_digest")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("_classes"))
        .withColumn("group_size", F.when(F.col("_classes") == 1, F.col("group_size")).otherwise(
            F.raise_error(F.lit("two different texts share a SHA-256 digest"))))
        .drop("_classes")
    )
    # At most HOT classes can hold over a HOT-th of all rows each: that list is bounded and
    # goes to every task. No other class is large enough to crowd a task of the shuffled join.
    all_rows = by_digest.agg(F.sum("group_size").alias("_all"))
    large = by_digest.join(F.broadcast(all_rows), F.col("group_size") * HOT > F.col("_all"))
    found = rows.select("doc_id", "text_sha256", digest.alias("_digest"))
    split = found.join(
        F.broadcast(large.select("_digest", F.col("keep_id").alias("_hot_id"), F.col("group_size").alias("_hot_size"))),
        "_digest", "left",
    )
    hot = split.where(F.col("_hot_size").isNotNull()).select(
        "doc_id", "text_sha256", F.col("_hot_id").alias("keep_id"), F.col("_hot_size").alias("group_size"))
    cold = split.where(F.col("_hot_size").isNull()).select("doc_id", "text_sha256", "_digest").join(by_digest, "_digest").drop("_digest")
    return hot.unionByName(cold).select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        "text_sha256",
    )
