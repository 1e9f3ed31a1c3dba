"""Running sums and ranks over groups of any size.

``row_number() over (partition by g order by o)`` sorts a whole group in one
task. Here rows are range-partitioned by group and order, every partition sums
its own part, and the parts are offset by the sums before them. A group that
holds most of the table is thus spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffloom.session import checkpointed


def running_total(df: DataFrame, group: list[str], order: list[Column], value: Column,
                  out: str, total: str | None = None) -> DataFrame:
    """Adds ``out``, the inclusive running sum of ``value`` per group in ``order``.

    ``order`` must be unique inside a group. ``total`` optionally adds the sum of
    the whole group. The range split is written to the shared checkpoint folder
    once: the two uses below must agree on it, whatever is recomputed later.
    """
    constant = "_all" if not group else None
    source = df.withColumn(constant, F.lit(0)) if constant else df
    keys = [constant] if constant else group
    split = checkpointed(
        source.withColumn("_value", value.cast("bigint"))
        .repartitionByRange(*[F.col(k) for k in keys], *order)
        .withColumn("_part", F.spark_partition_id())
    )
    # At most one row per group and range partition.
    by_part = Window.partitionBy(*keys).orderBy("_part")
    offsets = (
        split.groupBy(*keys, "_part").agg(F.sum("_value").alias("_sum"))
        .withColumn("_before", F.coalesce(
            F.sum("_sum").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_total", F.sum("_sum").over(Window.partitionBy(*keys)))
        .drop("_sum")
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    joined = split.join(offsets, [*keys, "_part"]).withColumn(
        out, F.col("_before") + F.sum("_value").over(inside)
    )
    if total:
        joined = joined.withColumn(total, F.col("_total"))
    return joined.drop("_value", "_part", "_before", "_total", *([constant] if constant else []))


def paginate(df: DataFrame, order: list[Column], per_page: int = 20) -> DataFrame:
    """Every row with its page and the page facts: page, per_page, totals, has_next, has_prev."""
    if not 1 <= per_page <= 100:
        raise ValueError("per_page must be between 1 and 100")
    ranked = running_total(df, [], order, F.lit(1), "_position", "total_items")
    pages = F.ceil(F.col("total_items") / per_page).cast("bigint")
    page = (F.floor((F.col("_position") - 1) / per_page) + 1).cast("bigint")
    return (
        ranked.withColumn("page", page)
        .withColumn("per_page", F.lit(per_page))
        .withColumn("total_pages", pages)
        .withColumn("has_next", F.col("page") < F.col("total_pages"))
        .withColumn("has_prev", F.col("page") > 1)
        .drop("_position")
    )
