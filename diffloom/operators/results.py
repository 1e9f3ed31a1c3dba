"""Served results: gate, lookup and the nested document of a review.

A document nests files and their issues. A review small enough for one document
is one row. A larger one is spread over several pages, each bounded in size:
no issue is dropped and no task ever holds a whole hot review.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom.session import checkpointed

ISSUES_PER_PART = 500
PARTS_PER_PAGE = 200
BROADCAST_KEYS = 100_000  #: most large files or reviews that are sent to every task


def gate_completed(tasks: DataFrame, analyses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks that can be served, refused tasks with a reason)."""
    done = tasks.filter(F.col("status") == "completed")
    owners = analyses.select(F.col("task_id").alias("id"))
    served = done.join(owners, "id", "left_semi")
    open_tasks = tasks.filter(~F.coalesce(F.col("status") == "completed", F.lit(False))).select(
        "id", F.lit("task_not_completed").alias("reason")
    )
    bare = done.join(owners, "id", "left_anti").select("id", F.lit("no_analysis").alias("reason"))
    return served, open_tasks.unionByName(bare)


def lookup(wanted: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found task rows, ids that do not exist)."""
    found = tasks.join(wanted.select("id"), "id", "left_semi")
    missing = wanted.select("id").join(tasks.select("id"), "id", "left_anti")
    return found, missing


def _bucket(value: Column, buckets: Column) -> Column:
    """Even, reproducible spread of string keys over a number of buckets."""
    head = F.conv(F.substring(F.md5(value.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return (head % buckets).cast("bigint")


def _few(keys: DataFrame) -> tuple[DataFrame, int]:
    """A table of keys, computed once, as a broadcast if it has few rows, and how many it has."""
    keys = checkpointed(keys)
    n = keys.count()
    return (F.broadcast(keys) if n <= BROADCAST_KEYS else keys), n


def _with_pieces(rows: DataFrame, oversized: DataFrame | None, keys: list[str], name: str) -> DataFrame:
    """Adds in how many pieces a group is cut: the value in ``oversized``, else 1."""
    if oversized is None:
        return rows.withColumn(name, F.lit(1).cast("bigint"))
    return rows.join(oversized, keys, "left").withColumn(name, F.coalesce(name, F.lit(1)))


def _oversized(owned: DataFrame, linked: DataFrame, review: str, file_key: list[str], per_part: int,
               per_page: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Files that are cut into parts and reviews that are cut into pages; nothing where there are none.

    Only the numbers of files and issues of each review are counted for all. A review with more than one page has
    more than ``per_page`` files and full parts, so the exact counts by file are made for few reviews, or none.
    """
    none = F.lit(0)
    counted = owned.select(review, F.lit(1).alias("files"), none.alias("issues")).unionByName(
        linked.select(review, none.alias("files"), F.lit(1).alias("issues"))).groupBy(review).agg(
        F.sum("files").alias("files"), F.sum("issues").alias("issues"))
    possible = counted.where((F.col("issues") > per_part) | (F.col("files") + F.col("issues") / per_part > per_page))
    asked, n = _few(possible.where(F.col(review).isNotNull()).select(review))
    if not n:
        return None, None
    large_files, n_files = _few(
        linked.join(asked, review, "left_semi").groupBy(*file_key)
        .agg(F.ceil(F.count(F.lit(1)) / per_part).cast("bigint").alias("parts")).filter(F.col("parts") > 1)
    )
    # A file is one unit, and each further part of a large file is one more.
    units = owned.join(asked, review, "left_semi").select(review, F.lit(1).cast("bigint").alias("n")).unionByName(
        large_files.select(review, (F.col("parts") - 1).alias("n"))
    )
    large_reviews, n_reviews = _few(
        units.groupBy(review).agg(F.ceil(F.sum("n") / per_page).cast("bigint").alias("pages")).filter(F.col("pages") > 1)
    )
    return (large_files if n_files else None), (large_reviews if n_reviews else None)


def result_documents(served: DataFrame, analyses: DataFrame, files: DataFrame, issues: DataFrame,
                     summary: DataFrame, per_part: int = ISSUES_PER_PART, per_page: int = PARTS_PER_PAGE) -> DataFrame:
    """The served document of every task that passed the gate.

    A file nests about ``per_part`` issues at most; one with more comes in several
    parts. A page nests about ``per_page`` file parts at most. Files without issues
    keep an empty list; issues without a file appear only in the totals.

    Large files and reviews are looked for first, by counts. Then tasks, files and issues meet in one shuffle by
    (analysis, page): both nesting steps and the join with the task reuse that partitioning.
    """
    review, file_key = "pr_analysis_id", ["pr_analysis_id", "file_analysis_id"]
    linked = issues.filter(F.col("file_analysis_id").isNotNull())
    owned = files.withColumnRenamed("id", "file_analysis_id")

    large_files, large_reviews = _oversized(owned, linked, review, file_key, per_part, per_page)

    def in_parts(rows: DataFrame) -> DataFrame:
        return _with_pieces(rows, large_files, file_key, "parts")

    def in_pages(rows: DataFrame) -> DataFrame:
        return _with_pieces(rows, large_reviews, [review], "pages")

    def placed(rows: DataFrame) -> DataFrame:
        key = F.concat_ws("#", F.col("file_analysis_id").cast("string"), F.col("part").cast("string"))
        return in_pages(rows).withColumn("page", F.when(F.col("pages") == 1, 0).otherwise(_bucket(key, F.col("pages"))))

    part_of_issue = F.when(F.col("parts") == 1, 0).otherwise(_bucket(F.col("id").cast("string"), F.col("parts")))
    issue_rows = placed(in_parts(linked).withColumn("part", part_of_issue)).select(
        *file_key, "part", "page",
        F.struct(
            "id", F.col("issue_type").alias("type"), "severity", "line_number", "column_number", "description",
            "suggestion", "rule_id", "confidence",
        ).alias("issue"),
    )
    every_part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    file_rows = placed(in_parts(owned).withColumn("part", every_part)).select(
        *file_key, "part", "page",
        F.struct(
            "file_path", F.col("file_type").alias("language"),
            F.coalesce("lines_added", F.lit(0)).alias("lines_added"),
            F.coalesce("lines_removed", F.lit(0)).alias("lines_removed"),
            "complexity_score",
        ).alias("file"),
    )
    task_rows = in_pages(_task_heads(served, analyses, summary)).select(
        review, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pages") - 1)).alias("page"),
        F.struct("head", "pages").alias("task"),
    )
    together = issue_rows.unionByName(file_rows, allowMissingColumns=True).unionByName(
        task_rows, allowMissingColumns=True
    )
    per_file = (
        together.repartition(review, "page")
        .groupBy(review, "page", "file_analysis_id", "part")
        .agg(
            F.first("task", ignorenulls=True).alias("task"),
            F.first("file", ignorenulls=True).alias("file"),
            F.array_sort(F.collect_list("issue")).alias("issues"),
        )
    )
    document = F.when(
        F.col("file").isNotNull(),
        F.struct(F.col("file_analysis_id").alias("id"), "part", "file.*", "issues"),
    )
    return (
        per_file.groupBy(review, "page")
        .agg(F.first("task", ignorenulls=True).alias("task"), F.array_sort(F.collect_list(document)).alias("files"))
        .filter(F.col("task").isNotNull())
        .select("task.head.*", "page", "task.pages", "files")
    )


def _task_heads(served: DataFrame, analyses: DataFrame, summary: DataFrame) -> DataFrame:
    """pr_analysis_id and ``head``: the part of a document that is not about single files."""
    tasks = served.select(
        F.col("id").alias("task_id"), F.col("repo_url").alias("github_repo"), "pr_number",
        F.coalesce("started_at", "created_at").alias("analysis_started_at"),
        F.col("completed_at").alias("analysis_completed_at"),
    )
    facts = analyses.select(
        F.col("id").alias("pr_analysis_id"), "task_id", "status",
        F.struct("recommendations", "pr_url", "base_branch", "head_branch").alias("metadata"),
    )
    totals = summary.select(
        "pr_analysis_id", F.struct(*[c for c in summary.columns if c != "pr_analysis_id"]).alias("summary")
    )
    joined = tasks.join(facts, "task_id").join(totals, "pr_analysis_id", "left")
    return joined.select(
        "pr_analysis_id",
        F.struct(
            "task_id", "status", "github_repo", "pr_number", "analysis_started_at", "analysis_completed_at",
            "summary", "metadata",
        ).alias("head"),
    )
