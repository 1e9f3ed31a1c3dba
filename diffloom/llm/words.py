"""Words of a text as columns, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 2_000_000  #: key tables above this many rows are joined by shuffle


def normal_words(text: Column) -> Column:
    """Runs of letters and digits in lower case; null and wordless texts give no words."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def word_rows(df: DataFrame, reach: int) -> DataFrame:
    """One row for each word of ``words`` with the ``reach - 1`` words behind it as w0, w1, ...

    ``at`` is the word's place from 0. The shifted word lists are zipped and inlined, so the whole
    texts stream through generated code and nothing is sorted or shuffled.
    """
    shifted = [F.slice("words", F.lit(k + 1), F.greatest(F.size("words"), F.lit(1))).alias(f"w{k}") for k in range(reach)]
    zipped = F.arrays_zip(*shifted)
    out = [*df.columns, F.posexplode(zipped).alias("at", "_w")]
    return df.select(*out).select(*df.columns, "at", *[F.col(f"_w.w{k}").alias(f"w{k}") for k in range(reach)])


def seed_hash(offsets: tuple[int, ...]) -> Column:
    """Hash of the words at these offsets; null where the text ends before the last."""
    key = F.xxhash64(F.lit(",".join(map(str, offsets))), *[F.col(f"w{k}") for k in offsets])
    return F.when(F.col(f"w{offsets[-1]}").isNotNull(), key)


def sent_to_tasks(table: DataFrame, rows: int) -> DataFrame:
    """``table`` marked for broadcast if its counted size allows, else as it is."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table
