"""The whole review: changed files in, scored files, issues and summaries out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.functions import text as tx
from diffloom.operators import files as fo
from diffloom.operators import issues as io
from diffloom.operators import rules, scores
from diffloom.session import checkpointed
from diffloom.sources.store import conform

REVIEW_RULES = [*rules.LINT_RULES, *rules.SECURITY_RULES]


def prepare(files: DataFrame) -> DataFrame:
    """Content choice and path parts; content, patch, additions and deletions columns may be absent."""
    optional = {"content": "string", "patch": "string", "additions": "bigint", "deletions": "bigint"}
    missing = {c: F.lit(None).cast(t) for c, t in optional.items() if c not in files.columns}
    return fo.with_path_parts(fo.select_content(files.withColumns(missing) if missing else files))


def review_files(files: DataFrame, extra_rules: list[rules.LineRule] | None = None,
                 extra_issues: DataFrame | None = None) -> DataFrame:
    """Scored file rows with their own findings in ``issues``.

    Content is read once: measures, findings and counts are all made in the
    file's row, so nothing is shuffled. ``extra_issues`` (raw issues with
    file_id and source, such as parsed model answers) arrive as one count row per file.
    """
    ready = fo.measure(prepare(files))
    found = rules.line_issues(tx.lines(F.col("content")), F.col("language"), [*REVIEW_RULES, *(extra_rules or [])])
    counted = ready.withColumn("issues", found).withColumns(io.counts_in_row(F.col("issues")))
    if extra_issues is not None:
        more = io.count_by_file(extra_issues).withColumnsRenamed({name: f"_{name}" for name in scores.COUNTS})
        counted = counted.join(more, "file_id", "left").withColumns(
            {name: F.col(name) + F.coalesce(f"_{name}", F.lit(0)) for name in scores.COUNTS}
        ).drop(*[f"_{name}" for name in scores.COUNTS])
    return scores.with_scores(counted).drop("content", "patch")


def issue_rows(reviewed: DataFrame) -> DataFrame:
    """The findings of reviewed files as raw issue rows."""
    return (
        reviewed.select("file_id", "pr_id", F.explode_outer("issues").alias("i"))
        .filter(F.col("i").isNotNull())
        .select("file_id", "pr_id", "i.*")
        .withColumn(
            "source",
            F.when(F.startswith(F.col("rule_id"), F.lit("security.")), "security").otherwise("quality"),
        )
    )


def summarise(files: DataFrame, pull_requests: DataFrame | None = None) -> DataFrame:
    """One assessment per pull request: one scan and one shuffle of small count rows."""
    return scores.summarise_prs(review_files(files), pull_requests)


def result_tables(files: DataFrame, tasks: DataFrame) -> dict[str, DataFrame]:
    """The stored tables of a run for ``tasks(id, pr_id, started_at, completed_at)``.

    Row ids are hashes of business keys: a repeated run produces the same rows.
    The reviewed rows (without content) are written to the shared folder once, so
    that the three tables do not each read and scan the content again.
    """
    reviewed = checkpointed(review_files(files))
    analysis_id = F.sha2(F.concat_ws("/", F.lit("analysis"), F.col("pr_id").cast("string")), 256)
    file_id = F.sha2(F.concat_ws("/", F.lit("file"), F.col("pr_id").cast("string"), F.col("file_id").cast("string")), 256)
    summary = scores.summarise_prs(reviewed)
    headers = scores.file_headers(reviewed).select(file_id.alias("id"), analysis_id.alias("pr_analysis_id"), "*")
    issues = io.normalise_issues(issue_rows(reviewed)).select(
        F.sha2(
            F.concat_ws("/", F.lit("issue"), F.col("pr_id").cast("string"), F.col("file_id").cast("string"),
                        F.col("line_number").cast("string"), F.col("rule_id")), 256
        ).alias("id"),
        analysis_id.alias("pr_analysis_id"), file_id.alias("file_analysis_id"), "*",
    )
    heads = tasks.join(summary, "pr_id").select(
        analysis_id.alias("id"), F.col("id").alias("task_id"), F.lit("completed").alias("status"),
        F.col("started_at").alias("analysis_started_at"), F.col("completed_at").alias("analysis_completed_at"),
        F.col("overall_score").alias("quality_score"), "recommendations",
    )
    statistics = scores.analysis_statistics(headers, issues).withColumnRenamed("pr_analysis_id", "id")
    tables = {"pr_analyses": heads.join(statistics, "id", "left"), "file_analyses": headers, "issues": issues}
    return {name: conform(name, rows) for name, rows in tables.items()}
