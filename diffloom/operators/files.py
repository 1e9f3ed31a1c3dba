"""Per-file measures: one narrow pass over the content, one row per file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.functions import normalize as nz
from diffloom.functions import text as tx
from diffloom.operators.rules import with_functions


def select_content(files: DataFrame) -> DataFrame:
    """The text to analyse: full content if there is one (even empty), else the patch."""
    return files.withColumns(
        {
            "content": F.coalesce("content", "patch", F.lit("")),
            "additions": F.coalesce("additions", F.lit(0)),
            "deletions": F.coalesce("deletions", F.lit(0)),
        }
    )


def measure(files: DataFrame) -> DataFrame:
    """Adds total_lines, code_lines, complexity_score, duplication_score, maintainability_score."""
    measured = (
        files.withColumn("_lines", tx.lines(F.col("content")))
        .withColumn("_nonblank", tx.nonblank_lines(F.col("_lines")))
        .withColumns(
            {
                "total_lines": F.size("_lines"),
                "code_lines": F.size("_nonblank"),
                "complexity_score": tx.keyword_complexity(F.col("content")),
                "duplication_score": tx.duplicate_line_ratio(F.col("_nonblank")),
            }
        )
    )
    return measured.withColumn(
        "maintainability_score",
        tx.maintainability(F.col("total_lines"), F.col("complexity_score"), F.col("duplication_score")),
    ).drop("_lines", "_nonblank")


def with_path_parts(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return files.withColumns(
        {
            "file_name": nz.file_name(path),
            "file_extension": nz.file_extension(path),
            "language": nz.language(path),
        }
    )


def flag_thresholds(files: DataFrame) -> DataFrame:
    """file_id plus one boolean per exceeded quality threshold."""
    longest = F.aggregate("functions", F.lit(0).cast("bigint"), lambda acc, f: F.greatest(acc, f["length"]))
    flags = tx.threshold_flags(
        longest, F.col("total_lines"), F.col("complexity_score"), F.col("duplication_score")
    )
    measured = measure(with_functions(files.select("file_id", "content")))
    return measured.select("file_id", flags.alias("f")).select("file_id", "f.*")


def default_metrics(metrics: DataFrame) -> DataFrame:
    """Values for files whose metrics are missing (fixed values)."""
    return metrics.na.fill(
        {
            "complexity_score": 5,
            "maintainability_score": 75,
            "language": "unknown",
            "total_lines": 0,
            "code_lines": 0,
            "duplication_score": 0.0,
        }
    )


def content_copies(files: DataFrame) -> DataFrame:
    """Groups of files with equal content: hash, first file, number of copies.

    Partial aggregation collapses a hot group before the shuffle.
    """
    return (
        files.select("file_id", tx.content_hash(F.col("content")).alias("content_hash"))
        .groupBy("content_hash")
        .agg(F.min("file_id").alias("first_file_id"), F.count(F.lit(1)).alias("copies"))
    )


def content_changes(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Compare two snapshots by ``keys``: added, removed, changed or same.

    Snapshots of several repositories pass the repository beside the path, so that equal
    paths of two repositories never meet. Only keys and hash travel, never the content.
    """
    def hashed(snapshot: DataFrame, name: str) -> DataFrame:
        return snapshot.select(*keys, tx.content_hash(F.col("content")).alias(name))

    change = (
        F.when(F.col("hash_before").isNull(), "added")
        .when(F.col("hash_after").isNull(), "removed")
        .when(F.col("hash_before") != F.col("hash_after"), "changed")
        .otherwise("same")
    )
    joined = hashed(before, "hash_before").join(hashed(after, "hash_after"), list(keys), "full_outer")
    return joined.select(*keys, change.alias("change"))
