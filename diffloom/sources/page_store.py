"""Stored lists that are read page by page, without ranking or opening the rest.

A list is written once in order, cut into files, with an index of which places and which keys each file holds. A page
opens the index and the files that hold the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.operators.ordering import running_total

PLACE = "_place"  #: counted from 1
MOST = 100  #: rows of a page


def write_list(rows: DataFrame, order: list[str], path: str, rows_per_file: int = 100_000) -> None:
    """Writes ``rows`` in ascending ``order`` (nulls first) to a new folder.

    The order must name a row. The index is written last: a list without one is unfinished, and readers fail on it.
    """
    ranked = running_total(rows, [], [F.col(c) for c in order], F.lit(1), PLACE, "_items")
    ranked.repartitionByRange(F.col(PLACE)).sortWithinPartitions(PLACE).write.option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/rows")
    stored = rows.sparkSession.read.schema(ranked.schema).parquet(f"{path}/rows")
    stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min(PLACE).alias("first"), F.max(PLACE).alias("last"), F.max("_items").alias("total"),
        F.max(F.struct(*order)).alias("last_key"),
    ).coalesce(1).write.parquet(f"{path}/index")


def _page_size(per_page: int) -> None:
    if not 1 <= per_page <= MOST:
        raise ValueError(f"per_page must be between 1 and {MOST}")


def _opened(spark: SparkSession, path: str, files: list) -> DataFrame | None:
    if not files:
        return None
    schema = spark.read.parquet(f"{path}/rows/{files[0]['file']}").schema
    return spark.read.schema(schema).parquet(*[f"{path}/rows/{f['file']}" for f in files])


def _empty(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").limit(0)


def read_page(spark: SparkSession, path: str, page: int, per_page: int = 20) -> DataFrame:
    """Rows of one page in order, with page, per_page, total_items, total_pages, has_next, has_prev; none beyond the end."""
    _page_size(per_page)
    if page < 1:
        raise ValueError("page must be at least 1")
    start, end = (page - 1) * per_page + 1, page * per_page
    # A page has at most MOST rows, so it lies in at most as many files.
    files = spark.read.parquet(f"{path}/index").where((F.col("last") >= start) & (F.col("first") <= end)).collect()
    rows = _opened(spark, path, files)
    if rows is None:
        rows = _empty(spark, path)
    pages = F.ceil(F.col("_items") / per_page).cast("bigint")
    return rows.where(F.col(PLACE).between(start, end)).orderBy(PLACE).select(
        *[c for c in rows.columns if c not in (PLACE, "_items")], F.lit(page).cast("bigint").alias("page"), F.lit(per_page).alias("per_page"),
        F.col("_items").alias("total_items"), pages.alias("total_pages"), (F.lit(page) < pages).alias("has_next"), F.lit(page > 1).alias("has_prev"))


def read_after(spark: SparkSession, path: str, after: dict | None, per_page: int = 20) -> DataFrame:
    """The next rows behind the row whose order columns have the values ``after``; the first ones for None."""
    _page_size(per_page)
    index = spark.read.parquet(f"{path}/index")
    names = index.schema["last_key"].dataType
    key: Column | None = None
    if after is not None:
        key = F.struct(*[F.lit(after[f.name]).cast(f.dataType).alias(f.name) for f in names.fields])
        index = index.where(F.col("last_key") > key)
    # Every file but the first one begins behind the key and has a row at least.
    files, rows_behind = [], 0
    for file in index.orderBy("first").limit(per_page + 1).collect():
        if rows_behind >= per_page:
            break
        rows_behind += file["last"] - file["first"] + 1 if files or key is None else 0
        files.append(file)
    rows = _opened(spark, path, files)
    if rows is None:
        rows = _empty(spark, path)
    if key is not None:
        rows = rows.where(F.struct(*[F.col(f.name) for f in names.fields]) > key)
    return rows.orderBy(PLACE).limit(per_page).drop(PLACE, "_items")
