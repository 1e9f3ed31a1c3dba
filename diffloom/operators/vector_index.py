"""A stored inverted-file index of vectors: coarse cells, residual codes of one byte a component, exact re-ranking.

Vectors are brought to length one and filed under the nearest of a set of centroids, as their difference from it
in bytes, with the length of what the bytes leave out. A search reads the lists of the cells nearest to each target:
codes give every score up to that known error, so whatever could be among the best k is kept and nothing else, and the
few that are left are scored from their stored vectors. Within the cells that are probed the result is exact; the best k of
all vectors may lie in others, so recall follows from the number of probes, and :func:`recall` measures it. Probing all
cells is the exact way, like :func:`diffloom.operators.similarity.find_similar`.

The corpus is read when it is filed. Later batches of targets read the lists, and added vectors are filed
under the same centroids in files of their own.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from diffloom.operators.similarity import SCORE_DIGITS, SCORES_AT_ONCE, UNIT_SLACK, _matrix, _nonzero, dot, lots

SAMPLE_ROWS = 20_000  #: centroids are fitted on at most this many vectors, those with the least hashes
MAX_CELLS = 1024  #: bounds what the driver and every task hold: cells x dimension floats
ROUNDS = 8
SLICE_ROWS = 8192  #: listed vectors that meet a slice of targets in one task
LISTS, VECTORS, CENTROIDS = "lists", "vectors", "centroids"
SLACK = 1e-6  #: scores are compared after rounding to SCORE_DIGITS


def _fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centroids by k-means over directions; an empty cell takes the vector that is worst served."""
    centroids = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        scores = sample @ centroids.T
        own = scores.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        lengths = np.linalg.norm(sums, axis=1)
        worst = np.argsort(scores.max(axis=1), kind="stable")
        for spare, cell in enumerate(np.flatnonzero(lengths == 0)):
            sums[cell], lengths[cell] = sample[worst[spare]], 1.0
        centroids = sums / lengths[:, None]
    return centroids


def _filed(centroids: np.ndarray):
    """Cell, bytes, their scale and the length of the error of each vector."""

    def run(batches):
        for batch in batches:
            vectors = _matrix(batch["vector"])
            cell = (vectors @ centroids.T).argmax(axis=1)
            rest = vectors - centroids[cell]
            scale = np.maximum(np.abs(rest).max(axis=1), 1e-12) / 127
            codes = np.round(rest / scale[:, None]).astype(np.int8)
            batch["cell"] = cell.astype(np.int32)
            batch["code"] = [row.tobytes() for row in codes]
            batch["scale"] = scale
            # Rounding of the products themselves is far below the slack.
            batch["error"] = np.linalg.norm(rest - codes * scale[:, None], axis=1) + SLACK
            yield batch

    return run


def _length(vector: Column) -> Column:
    """What a vector is divided by: its length, or 1 where that is 1 up to rounding."""
    length = F.sqrt(dot(vector, vector))
    return F.when(F.abs(length - 1) > UNIT_SLACK, length).otherwise(1.0)


class VectorIndex:
    """An index at a path; made by :func:`build`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/{CENTROIDS}").orderBy("cell").collect()  # at most MAX_CELLS
        self.centroids = np.array([r["vector"] for r in rows])

    @property
    def cells(self) -> int:
        return len(self.centroids)

    def _read(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{part}")

    def add(self, vectors: DataFrame, id_col: str = "id", vector_col: str = "embedding") -> None:
        """Files more vectors. Null and zero vectors and rows without an id have no part; an id is filed as often as it comes.

        Lists are sorted by cell, so that a search skips the parts of files that hold other cells. Files are
        written under a name of this call and become visible as a whole folder each, the vectors before the lists.
        """
        plain = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
        fit = _nonzero(plain.where("id is not null and vector is not null"))
        schema = f"id {plain.schema['id'].dataType.simpleString()}, vector array<double>, cell int, code binary, scale double, error double"
        dealt = fit.mapInPandas(_filed(self.centroids), schema).repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")
        name = f"batch={uuid.uuid4().hex}"
        staged = f"{self.path}/staged/{name}"
        dealt.write.parquet(staged)
        whole = self.spark.read.schema(dealt.schema).parquet(staged)
        whole.select("cell", "id", "vector").write.parquet(f"{self.path}/{VECTORS}/{name}")
        whole.select("cell", "id", "code", "scale", "error").write.parquet(f"{self.path}/{LISTS}/{name}")

    def search(self, targets: DataFrame, target_id: str, corpus_id: str, vector_col: str = "embedding", top_k: int = 5,
               threshold: float | None = None, probes: int | None = None) -> DataFrame:
        """The best ``top_k`` filed vectors of each target among those in its ``probes`` nearest cells (all, if None).

        ``target_id``, ``corpus_id``, ``score`` (cosine, 6 digits) and ``rank``; higher scores first, ties by smaller id;
        with a ``threshold`` only scores that reach it. A cell with most of the vectors is cut into slices, each a task.
        """
        probes = self.cells if probes is None else max(1, min(probes, self.cells))
        centroids, least = self.centroids, -math.inf if threshold is None else threshold
        plain = targets.select(F.col(target_id).alias("target"), F.col(vector_col).cast("array<double>").alias("wanted"))
        asked = plain.where("target is not null and wanted is not null").where(F.exists("wanted", lambda x: x != 0))

        def near(batches):
            for batch in batches:
                scores = _matrix(batch["wanted"]) @ centroids.T
                cells = np.argpartition(-scores, probes - 1, axis=1)[:, :probes]
                row, cells = np.repeat(np.arange(len(batch)), probes), cells.reshape(-1).astype(np.int32)
                for some in lots(len(row), centroids.shape[1]):
                    out = batch.iloc[row[some]].reset_index(drop=True)
                    out["cell"] = cells[some]
                    yield out

        target_type, lists = asked.schema["target"].dataType.simpleString(), self._read(LISTS)
        visits = asked.mapInPandas(near, f"target {target_type}, wanted array<double>, cell int")
        # Targets of a cell are cut, too: a task holds one slice of either side.
        of = asked.agg(F.ceil(F.count(F.lit(1)) / SLICE_ROWS).cast("int")).first()[0]
        visits = visits.withColumn("part", F.pmod(F.xxhash64("target"), F.lit(max(1, of))).cast("int"))
        counts = lists.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SLICE_ROWS).cast("int").alias("slices"))
        if probes < self.cells:
            visited = [r["cell"] for r in visits.select("cell").distinct().collect()]  # at most MAX_CELLS
            lists = lists.where(F.col("cell").isin(visited))
        slices = F.broadcast(counts)  # one row for each cell, at most MAX_CELLS
        left = lists.join(slices, "cell").withColumn("slice", F.pmod(F.xxhash64("id"), "slices").cast("int")).drop("slices").withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.lit(max(1, of) - 1))))
        right = visits.join(slices, "cell").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
        id_type = left.schema["id"].dataType.simpleString()

        def match(listed: pd.DataFrame, visiting: pd.DataFrame) -> pd.DataFrame:
            found = [pd.DataFrame({"target": [], "id": [], "low": [], "high": [], "cell": []})]
            if listed.empty or visiting.empty:
                return found[0]
            cell = int(listed["cell"].iloc[0])
            codes = np.frombuffer(b"".join(listed["code"]), np.int8).reshape(len(listed), -1) * listed["scale"].to_numpy()[:, None]
            ids, error = listed["id"].to_numpy(), listed["error"].to_numpy()[:, None]
            step = max(1, SCORES_AT_ONCE // len(listed))
            for at in range(0, len(visiting), step):
                some = visiting.iloc[at : at + step]
                wanted = _matrix(some["wanted"])
                scores = codes @ wanted.T + wanted @ centroids[cell]
                floor = np.full(scores.shape[1], -np.inf)
                if len(listed) > top_k:
                    floor = np.partition(scores - error, len(listed) - top_k, axis=0)[len(listed) - top_k]
                row, column = np.nonzero(scores + error >= np.maximum(floor, least - SLACK)[None, :])
                score = scores[row, column]
                found.append(pd.DataFrame({"target": some["target"].to_numpy()[column], "id": ids[row], "low": score - error[row, 0],
                                           "high": score + error[row, 0], "cell": cell}))
            return pd.concat(found[1:])

        candidates = left.groupBy("cell", "slice", "part").cogroup(right.groupBy("cell", "slice", "part")).applyInPandas(
            match, f"target {target_type}, id {id_type}, low double, high double, cell int")
        # What lies surely below the k-th of all cells goes before any vector is read.
        of_target = Window.partitionBy("target")
        placed = candidates.withColumn("_n", F.row_number().over(of_target.orderBy(F.desc("low"))))
        floor = F.min(F.when(F.col("_n") <= top_k, F.col("low"))).over(of_target)
        left_over = placed.withColumn("_floor", floor).where(F.col("high") >= F.col("_floor") - SLACK).select("target", "id", "cell")
        vectors = self._read(VECTORS).select("cell", "id", "vector")
        scored = left_over.distinct().join(vectors, ["cell", "id"]).join(asked, "target").select(
            "target", "id", F.round(dot(F.col("vector"), F.col("wanted")) / (_length(F.col("vector")) * _length(F.col("wanted"))), SCORE_DIGITS).alias("score"))
        best = Window.partitionBy("target").orderBy(F.desc("score"), "id")
        ranked = scored.where(F.col("score") >= least).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)
        return ranked.select(F.col("target").alias(target_id), F.col("id").alias(corpus_id), "score", "rank")


def build(vectors: DataFrame, path: str, id_col: str = "id", vector_col: str = "embedding", cells: int | None = None) -> VectorIndex:
    """Fits centroids on a bounded sample, writes them to ``path`` and files all vectors. Cells: the root of their number, if not given."""
    spark = vectors.sparkSession
    plain = _nonzero(vectors.select(F.col(vector_col).cast("array<double>").alias("vector")).where("vector is not null"))
    n = plain.count()
    if not n:
        raise ValueError("an index needs at least one vector that is not zero")
    rows = plain.orderBy(F.xxhash64("vector")).limit(SAMPLE_ROWS).collect()
    sample = _matrix(pd.Series([r["vector"] for r in rows]))
    cells = max(1, min(math.isqrt(n) if cells is None else cells, MAX_CELLS, len(sample)))
    table = [(k, [float(x) for x in c]) for k, c in enumerate(_fitted(sample, cells))]
    spark.createDataFrame(table, "cell int, vector array<double>").coalesce(1).write.parquet(f"{path}/{CENTROIDS}")
    index = VectorIndex(spark, path)
    index.add(vectors, id_col, vector_col)
    return index


def recall(found: DataFrame, exact: DataFrame, target_id: str, corpus_id: str) -> float:
    """The share of the exact result's rows that were found; 1 if there are none."""
    keys = [target_id, corpus_id]
    row = exact.select(*keys).join(found.select(*keys).withColumn("_found", F.lit(1)), keys, "left").agg(
        F.count(F.lit(1)), F.count("_found")).first()
    return row[1] / row[0] if row[0] else 1.0
