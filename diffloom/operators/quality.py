"""Record checks: refused rows are kept with their reasons, never dropped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom.functions import normalize as nz


def validate_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted requests with owner and repository, refused requests with reasons)."""
    checked = requests.withColumn(
        "reasons", nz.request_reasons(F.col("repo_url"), F.col("pr_number"), F.col("priority"))
    )
    where = nz.split_repo_url_lenient(F.col("repo_url"))
    accepted = checked.filter(F.size("reasons") == 0).drop("reasons").withColumns(
        {
            "priority": F.coalesce("priority", F.lit("normal")),
            "repo_owner": where["owner"],
            "repo_name": where["repo"],
        }
    )
    return accepted, checked.filter(F.size("reasons") > 0)


def split_by_error(rows: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with ``error``): one bad file never fails the review."""
    marked = rows.withColumn("error", error)
    return marked.filter(F.col("error").isNull()).drop("error"), marked.filter(F.col("error").isNotNull())


def file_error(encoding: Column, content: Column) -> Column:
    """Why a fetched file cannot be analysed, or null."""
    packed = F.try_to_binary(F.regexp_replace(content, r"\s", ""), F.lit("base64"))
    return (
        F.when(content.isNull(), F.lit("missing content"))
        .when((encoding == "base64") & packed.isNull(), F.lit("invalid base64"))
        .when((encoding == "base64") & ~F.is_valid_utf8(packed.cast("string")), F.lit("invalid text"))
    )
