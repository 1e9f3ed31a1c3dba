"""Whole and broken sets of landed file pages: what is missing is reported, not passed on as a small pull request.

A listing is whole if its pages run from 1 without a gap, all but the last are full, and the last is not full or an
empty page follows (or the pull request names just as many files). Pages that arrive again with the same files count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.sources.landing import PAGE_SIZE, pr_files


def page_report(pages: DataFrame, pulls: DataFrame | None = None, page_size: int = PAGE_SIZE) -> DataFrame:
    """One row for each pull request: pr_id (text), pages, files, last_page, repeated, problems (array, empty if whole).

    ``pulls`` has pr_id and changed_files (0 or null: not known); with it, pull requests without pages and pages without a
    pull request are reported, too. Only numbers and digests of pages are shuffled.
    """
    number = F.coalesce("page", F.lit(1))
    sized = pages.select(F.col("pr_id").cast("string").alias("pr_id"), number.alias("page"),
                         F.greatest(F.coalesce(F.size("files"), F.lit(0)), F.lit(0)).alias("n"), F.sha2(F.to_json("files"), 256).alias("digest"))
    by_page = sized.groupBy("pr_id", "page").agg(
        F.count(F.lit(1)).alias("deliveries"), F.max("n").alias("n"),
        ((F.min("digest") != F.max("digest")) | (F.min("n") != F.max("n"))).alias("differs"))
    filled = F.col("n") > 0
    counted = by_page.groupBy("pr_id").agg(
        F.count_if(filled).alias("pages"), F.sum("n").alias("files"),
        F.coalesce(F.max(F.when(filled, F.col("page"))), F.lit(0)).alias("last_page"), F.max("page").alias("_seen"), F.min("page").alias("_first"),
        F.coalesce(F.max_by("n", F.when(filled, F.col("page"))), F.lit(0)).alias("_last_n"),
        F.count_if(filled & (F.col("n") < page_size)).alias("_short"), F.count_if(F.col("n") > page_size).alias("_long"),
        F.sum(F.col("deliveries") - 1).alias("repeated"), F.count_if("differs").alias("_differs"))
    met = counted.withColumns({"declared": F.lit(None).cast("bigint"), "_known": F.lit(True), "_paged": F.lit(True)})
    if pulls is not None:
        named = pulls.where("pr_id IS NOT NULL").groupBy(F.col("pr_id").cast("string").alias("pr_id")).agg(
            F.nullif(F.max("changed_files").cast("bigint"), F.lit(0).cast("bigint")).alias("declared"), F.lit(True).alias("_known"))
        met = counted.withColumn("_paged", F.lit(True)).join(named, "pr_id", "full_outer")
    met = met.na.fill(0, ["pages", "files", "last_page", "repeated", "_seen", "_last_n", "_short", "_long", "_differs"]).na.fill(False, ["_known", "_paged"])
    last_short = (F.col("_last_n") > 0) & (F.col("_last_n") < page_size)
    ended = (F.col("_last_n") < page_size) | (F.col("_seen") > F.col("last_page")) | F.coalesce(F.col("declared") == F.col("files"), F.lit(False))
    tests = {
        "no pull request": F.col("pr_id").isNull() | ~F.col("_known"),
        "no pages": ~F.col("_paged") & F.col("declared").isNotNull(),
        "bad page number": F.col("_first") < 1,
        "missing pages": F.col("pages") < F.col("last_page"),
        "short pages": F.col("_short") > last_short.cast("int"),
        "long pages": F.col("_long") > 0,
        "different deliveries": F.col("_differs") > 0,
        "no last page": F.col("_paged") & ~ended,
        "other number of files": F.col("_paged") & (F.col("declared") != F.col("files")),
    }
    problems = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    return met.select("pr_id", "pages", "files", "last_page", "repeated", problems.alias("problems"))


def whole_files(pages: DataFrame, pulls: DataFrame | None = None, page_size: int = PAGE_SIZE) -> tuple[DataFrame, DataFrame]:
    """(file rows of whole listings as :func:`diffloom.sources.landing.pr_files` gives them, reports of all others).

    Pages that were delivered once go straight on; only listings with repeated ones are grouped by page.
    """
    report = page_report(pages, pulls, page_size)
    whole = report.where((F.size("problems") == 0) & F.col("pr_id").isNotNull()).select(F.col("pr_id").alias("_pr"), F.col("repeated").alias("_again"))
    good = pages.withColumn("page", F.coalesce("page", F.lit(1))).join(whole, F.col("pr_id").cast("string") == F.col("_pr"))
    once = good.where("_again = 0").unionByName(good.where("_again > 0").dropDuplicates(["pr_id", "page"]))
    return pr_files(once, page_size), report.where(F.size("problems") > 0)
