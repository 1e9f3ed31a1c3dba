"""Diff impact: counts, symbols, score, risk and change type of every patch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.functions import diffs as dx
from diffloom.functions import text as tx


def patch_lines(files: DataFrame) -> DataFrame:
    """One row per patch line with its kind."""
    return files.select(
        "file_id", F.posexplode_outer(tx.lines(F.col("patch"))).alias("pos", "line")
    ).filter(F.col("line").isNotNull()).select("file_id", (F.col("pos") + 1).alias("line_no"), "line", dx.line_kind(F.col("line")).alias("kind"))


def diff_counts(files: DataFrame) -> DataFrame:
    """Adds lines_added, lines_removed and the sorted affected_functions."""
    return (
        files.withColumn("_lines", tx.lines(F.coalesce("patch", F.lit(""))))
        .withColumn("_added", F.filter("_lines", lambda line: dx.line_kind(line) == "added"))
        .withColumn("_removed", F.filter("_lines", lambda line: dx.line_kind(line) == "removed"))
        .withColumns(
            {
                "lines_added": F.size("_added").cast("bigint"),
                "lines_removed": F.size("_removed").cast("bigint"),
                "affected_functions": dx.affected_functions(F.concat("_added", "_removed")),
            }
        )
        .drop("_lines", "_added", "_removed")
    )


def diff_impact(files: DataFrame) -> DataFrame:
    """One impact row per file; a missing or empty patch gives the no-change row."""
    counted = diff_counts(files.select("file_id", "path", "status", "additions", "deletions", "patch"))
    empty = F.coalesce(F.col("patch") == "", F.lit(True))
    scored = counted.withColumn(
        "impact_score",
        F.when(empty, F.lit(0)).otherwise(
            dx.impact_score(
                F.col("lines_added"), F.col("lines_removed"), F.size("affected_functions"), F.col("path")
            )
        ).cast("bigint"),
    )
    return scored.select(
        "file_id",
        "impact_score",
        F.when(empty, "low").otherwise(dx.risk_level(F.col("impact_score"), F.col("path"), F.col("status")))
        .alias("risk_level"),
        F.when(empty, "no_changes")
        .otherwise(dx.change_type(F.col("status"), F.col("additions"), F.col("deletions")))
        .alias("change_type"),
        "affected_functions",
        "lines_added",
        "lines_removed",
        (F.col("lines_added") - F.col("lines_removed")).alias("net_lines"),
    )
