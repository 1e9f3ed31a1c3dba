"""Hard negatives by slot-decomposed selection: disjoint score slots, combiners, and suffix merges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffloom.session import checkpointed

BLOCK_ROWS = 2048  #: rows of one packed block at most
BLOCK_BYTES = 8 << 20
CELL_BLOCKS = 32  #: blocks on a side of a cell, so that a task holds about half a gigabyte at most
EXACT = 2.0**53  #: sums up to here are exact in doubles
LONG = 2**63
PACKED = "block bigint, ids binary, labels binary, vectors binary, limits binary"
HITS = "anchor_id bigint, slot int, score bigint, vec_id bigint"


def taking_part(rows: DataFrame) -> DataFrame:
    """``vec_id``, ``label`` and ``embedding`` of the rows with an id, a label and only finite components."""
    unfit = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    found = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
                        F.col("embedding").cast("array<double>").alias("embedding"))
    return found.where("vec_id is not null and label is not null and embedding is not null").where(~unfit)


class _Block:
    """Rows of a packed block; ``limits`` has the descending upper limits of each row and its least lower limit at last."""

    def __init__(self, row: dict):
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(self.ids), -1)
        self.limits = None if row["limits"] is None else np.frombuffer(row["limits"], np.int64).reshape(len(self.ids), -1)


def _block_batch(number: int, batch: pa.RecordBatch, scale: float) -> pa.RecordBatch:
    ids, labels, vectors, limits = (c.to_pylist() for c in batch.columns)
    # Shorter vectors go on with zeros, which leave an inner product as it is.
    wide = np.zeros((len(ids), max(map(len, vectors))))
    for k, v in enumerate(vectors):
        wide[k, : len(v)] = v
    # A product too large for a double is infinite; the largest double stands for it.
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(wide * scale), -np.finfo(float).max, np.finfo(float).max)
    packed = [np.array(ids, np.int64), np.array(labels, np.int64), whole, None if limits[0] is None else np.array(limits, np.int64)]
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), *[pa.array([None if v is None else v.tobytes()], pa.binary()) for v in packed]],
        names=["block", "ids", "labels", "vectors", "limits"])


def _blocks(rows: DataFrame, scale: float, size: int) -> DataFrame:
    """``rows`` in blocks of up to ``size``; rows without a ``limits`` column have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                yield _block_batch(number, batch.slice(at, size), scale)
                number += 1

    limits = F.col("limits") if "limits" in rows.columns else F.lit(None).cast("array<bigint>").alias("limits")
    return rows.select("vec_id", "label", "embedding", limits).mapInArrow(run, PACKED)


def _inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of x with all of y, exact; beyond 64 bits they saturate."""
    width = max(x.shape[1], y.shape[1])
    x, y = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (x, y))
    bound = (np.abs(x).max(initial=0) + 1) * (np.abs(y).max(initial=0) + 1) * max(width, 1)
    if bound < EXACT:
        return (x @ y.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    product = whole(x).dot(whole(y).T)
    return np.clip(product, -LONG, LONG - 1).astype(np.int64)


def _best(score: np.ndarray, wanted: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's first k wanted columns: higher scores first, then smaller ids."""
    if score.shape[1] > 4 * k:
        # Nothing below a row's k-th score can be among its first k; ties with it all stay.
        masked = np.where(wanted, score, -LONG)
        wanted = wanted & (masked >= np.partition(masked, -k, axis=1)[:, -k, None])
    rows, columns = np.nonzero(wanted)
    order = np.lexsort((ids[columns], ~score[rows, columns], rows))  # ~x orders like -x and never overflows
    rows, columns = rows[order], columns[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[kept], columns[kept]


def _hits(anchor_ids: np.ndarray, slots: np.ndarray, scores: np.ndarray, vec_ids: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"anchor_id": anchor_ids, "slot": slots.astype(np.int32), "score": scores, "vec_id": vec_ids})


def _first_of_label(anchors: _Block, rows: _Block, k: int) -> pd.DataFrame:
    """Each anchor's first k other rows of its label in this block, as slot 0."""
    score = _inner(anchors.vectors, rows.vectors)
    wanted = (anchors.labels[:, None] == rows.labels) & (anchors.ids[:, None] != rows.ids)
    x, y = _best(score, wanted, rows.ids, k)
    return _hits(anchors.ids[x], np.zeros(len(x)), score[x, y], rows.ids[y])


def _first_of_slots(anchors: _Block, rows: _Block, k: int) -> pd.DataFrame:
    """Each anchor's first k rows of another label in each of its slots, in this block.

    A row lies in the last slot whose upper limit its score does not exceed.
    """
    score = _inner(anchors.vectors, rows.vectors)
    upper, least = anchors.limits[:, :-1], anchors.limits[:, -1:]
    slot = np.full(score.shape, -1, np.int32)
    for j in range(upper.shape[1]):
        slot[score <= upper[:, j : j + 1]] = j
    wanted = (anchors.labels[:, None] != rows.labels) & (anchors.ids[:, None] != rows.ids) & (score >= least)
    found = []
    for j in range(upper.shape[1]):
        x, y = _best(score, wanted & (slot == j), rows.ids, k)
        found.append(_hits(anchors.ids[x], np.full(len(x), j), score[x, y], rows.ids[y]))
    return pd.concat(found)


def _met(anchors: DataFrame, corpus: DataFrame, down: int, across: int, find, k: int) -> DataFrame:
    """``find`` over all pairs of an anchor block and a corpus block, which meet in the cells of a grid.

    A corpus block is sent once for each row of the grid, an anchor block once for each column. Inside a cell the hits
    of its blocks are combined to the first k of an (anchor, slot) before they leave the task.
    """

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        blocks = [[_Block(r) for r in part.to_dict("records")] for part in (cell[cell["asks"]], cell[~cell["asks"]])]
        out = [_hits(*[np.zeros(0, np.int64)] * 4)]
        for anchors in blocks[0]:
            hits = pd.concat([find(anchors, rows, k) for rows in blocks[1]] or out[:1])
            order = np.lexsort((hits["vec_id"], ~hits["score"].to_numpy(), hits["slot"], hits["anchor_id"]))
            out.append(hits.iloc[order].groupby(["anchor_id", "slot"], sort=False).head(k))
        return pd.concat(out)

    place = F.xxhash64("block")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select("*", F.lit(True).alias("asks"), F.pmod(place, F.lit(down)).cast("int").alias("i"), every(across).alias("j"))
    right = corpus.select("*", F.lit(False).alias("asks"), every(down).alias("i"), F.pmod(place, F.lit(across)).cast("int").alias("j"))
    # A number of its own: cells hold few bytes for their work, and must not be merged by bytes.
    spark = corpus.sparkSession
    parts = min(down * across, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
    return left.unionByName(right).repartition(parts, "i", "j").groupBy("i", "j").applyInPandas(run, HITS)


def _first(hits: DataFrame, k: int) -> DataFrame:
    """The first k hits of each (anchor, slot), by ``place`` from 0. Spark prunes to k in each task before it shuffles."""
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return ranked.withColumn("place", F.col("place") - 1)


def hard_negatives(rows: DataFrame, is_anchor: Column, scale: float = 256.0, positives: int = 5, negatives: int = 3,
                   low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    ``rows`` has ``vec_id``, ``embedding`` and ``label``; ``is_anchor`` is a condition on vec_id. Components become
    ``floor(scale * x)``; a row's score is its integer inner product with the anchor, and higher scores come
    first, ties by smaller vec_id. An anchor's positives are its first ``positives`` other rows of its label; a positive's
    negatives the first ``negatives`` rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``.

    The windows of an anchor's positives overlap. Their upper limits cut the scores into disjoint slots; blocks, cells
    and the combiners behind them keep the first ``negatives`` of each slot. A window is a suffix of the slots,
    cut at its lower limit: merging the slots downwards answers all windows from at most ``positives * negatives``
    rows of an anchor. Anchors and rows meet in blocks, once for the positives and once for the slots. Labels are masks
    inside a block, so a label with most of the rows is spread like any other.

    Rows without vec_id, label or vector and rows with a null or non-finite component take no part. Vectors of different
    lengths are compared as if they went on with zeros. Scores beyond 64 bits saturate. Rows that share an anchor's
    vec_id are neither its positives nor its negatives; of several anchors with one vec_id the one with the least
    label, then vector, asks. Other repeated rows count each. Anchors without positives, and positives whose window is
    empty or below zero, give no rows, like an empty table. Other columns fall away.
    """
    if not 0 <= low <= high <= 100:
        raise ValueError("0 <= low <= high <= 100 must hold")
    fit = taking_part(rows)
    asking = fit.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r")).select("vec_id", "r.*")
    facts = fit.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(1)), F.count_if(is_anchor)).first()
    n_rows, width, n_anchors = facts
    size = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(width, 1))))
    down = max(1, -(-n_anchors // (size * CELL_BLOCKS)))
    # As many columns as keep all cores busy, and no cell above its bound.
    cores = fit.sparkSession.sparkContext.defaultParallelism
    across = max(1, -(-n_rows // (size * CELL_BLOCKS)), min(4 * cores, -(-n_rows // size)))
    corpus = _blocks(fit, scale, size)

    nearest = _first(_met(_blocks(asking, scale, size), corpus, down, across, _first_of_label, positives), positives)
    s = F.col("score")
    # Whole hundreds apart, so that no product overflows.
    upper = F.expr(f"score div 100 * {high} + score % 100 * {high} div 100")
    lower = F.expr(f"score div 100 * {low} + (score % 100 * {low} + 99) div 100")
    windows = checkpointed(nearest.where(s >= 0).select(
        "anchor_id", "place", F.col("vec_id").alias("positive_id"), s.alias("positive_score"), upper.alias("upper"), lower.alias("lower")))
    # One row of at most ``positives`` limits for each anchor; missing ones lie below every score.
    listed = windows.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.sort_array(F.collect_list("upper"), asc=False).alias("_upper"), F.min("lower").alias("_lower"))
    padded = F.concat("_upper", F.array_repeat(F.lit(-LONG), F.lit(positives) - F.size("_upper")), F.array("_lower"))
    limited = asking.join(listed, "vec_id").withColumn("limits", padded)

    slots = _first(_met(_blocks(limited, scale, size), corpus, down, across, _first_of_slots, negatives), negatives)
    entry = F.struct("slot", "place", "score", "vec_id")
    merged = slots.groupBy("anchor_id").agg(F.sort_array(F.collect_list(entry)).alias("_slots"))
    suffix = F.filter("_slots", lambda e: (e["slot"] >= F.col("place")) & (e["score"] >= F.col("lower")))
    return windows.join(merged, "anchor_id").select(
        "anchor_id", "positive_id", "positive_score", F.posexplode(F.slice(suffix, 1, negatives)).alias("_at", "_n")
    ).select("anchor_id", "positive_id", (F.col("_at") + 1).alias("rank"), F.col("_n.vec_id").alias("negative_id"),
             "positive_score", F.col("_n.score").alias("negative_score"))
