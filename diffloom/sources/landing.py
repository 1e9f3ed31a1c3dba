"""Readers for landing files. Fetching over the network is not part of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom import schemas

PAGE_SIZE = 100


def read_pull_requests(spark: SparkSession, path: str) -> DataFrame:
    return pull_requests(spark.read.schema(schemas.PULL_REQUEST_JSON).json(path))


def pull_requests(raw: DataFrame) -> DataFrame:
    """Flat pull-request rows from the nested records."""
    return raw.select(
        F.col("id").alias("pr_id"),
        F.col("_metadata.owner").alias("repo_owner"),
        F.col("_metadata.repo").alias("repo_name"),
        "number", "title", "body", "state",
        F.col("user.login").alias("author"),
        F.col("head.ref").alias("head_ref"),
        F.col("head.sha").alias("head_sha"),
        F.col("base.ref").alias("base_ref"),
        F.col("base.sha").alias("base_sha"),
        F.coalesce("changed_files", F.lit(0)).alias("changed_files"),
        "additions", "deletions", "commits", "html_url", "created_at", "updated_at",
        F.col("_metadata.fetched_at").alias("fetched_at"),
    )


def read_pr_files(spark: SparkSession, path: str) -> DataFrame:
    return pr_files(spark.read.schema(schemas.PR_FILES_PAGE_JSON).json(path))


def pr_files(pages: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """One row per changed file, from pages of files.

    Every page is read; a page without a number counts as the first. The page number
    gives a file its place, so the order needs no shuffle.
    """
    return (
        pages.select("pr_id", F.coalesce("page", F.lit(1)).alias("page"), F.posexplode("files").alias("pos", "file"))
        .select("pr_id", ((F.col("page") - 1) * page_size + F.col("pos")).alias("file_index"), "file.*")
    )


def read_file_contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FILE_CONTENT_JSON).json(path)


def decoded_content(encoding: Column, content: Column) -> Column:
    """Text of a fetched file: base64 decoded, else as it is; '' if missing or undecodable."""
    packed = F.try_to_binary(F.regexp_replace(content, r"\s", ""), F.lit("base64"))
    return F.coalesce(
        F.when(encoding == "base64", F.try_validate_utf8(packed.cast("string"))).otherwise(content), F.lit("")
    )


def attach_contents(files: DataFrame, fetched: DataFrame) -> DataFrame:
    """Files with their decoded content; a file that was not found has ''."""
    texts = fetched.select(
        "pr_id", "filename", decoded_content(F.col("encoding"), F.col("content")).alias("content")
    )
    joined = files.drop("content").join(texts, ["pr_id", "filename"], "left")
    return joined.withColumn("content", F.coalesce("content", F.lit("")))


def read_repositories(spark: SparkSession, path: str) -> DataFrame:
    return repositories(spark.read.schema(schemas.REPOSITORY_JSON).json(path))


def repositories(raw: DataFrame) -> DataFrame:
    return raw.select(
        "owner", "repo", "language", F.coalesce("stargazers_count", F.lit(0)).alias("stars"),
        "default_branch", "private",
    )


def with_repository(rows: DataFrame, repos: DataFrame) -> DataFrame:
    """Adds repository attributes. The join strategy follows the measured size of the dimension."""
    dimension = repos.withColumnsRenamed({"owner": "repo_owner", "repo": "repo_name"})
    return rows.join(dimension, ["repo_owner", "repo_name"], "left").withColumn(
        "stars", F.coalesce("stars", F.lit(0))
    )


def webhook_events(raw: DataFrame) -> DataFrame:
    """Review requests from webhook records; works on a batch and on a stream."""
    return raw.select(
        "action",
        F.col("repository.html_url").alias("repo_url"),
        F.col("pull_request.number").alias("pr_number"),
        F.col("pull_request.title").alias("title"),
        F.col("pull_request.user.login").alias("author"),
        F.col("pull_request.head.sha").alias("head_sha"),
        F.col("sender.login").alias("sender"),
        F.lit("normal").alias("priority"),
    )
