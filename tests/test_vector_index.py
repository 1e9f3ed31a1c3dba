"""The stored vector index: exact when all cells are probed, measured recall when not, batches without the corpus."""

import numpy as np
import pytest

from diffloom.operators import similarity, vector_index


def frame(spark, matrix, first=0, name="id"):
    rows = [(first + i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{name} bigint, embedding array<double>").repartition(3)


def corpus(seed, n, dimension, centres, noise):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dimension))
    return middle[rng.integers(0, centres, n)] + noise * rng.normal(size=(n, dimension))


def plain(targets, matrix, k):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(targets) @ unit(matrix).T, 6)
    out = []
    for t, row in enumerate(scores):
        order = np.lexsort((np.arange(len(row)), -row))[:k]
        out += [(t, int(i), float(row[i]), r + 1) for r, i in enumerate(order)]
    return out


def rows(found):
    return sorted((r["target"], r["id"], round(r["score"], 6), r["rank"]) for r in found.collect())


def test_all_cells_are_exact(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "SLICE_ROWS", 60)
    matrix = corpus(1, 500, 24, 12, 0.4)
    matrix = np.concatenate([matrix, np.repeat(matrix[:1], 150, axis=0) + 1e-4 * np.arange(150)[:, None]])
    targets = corpus(1, 40, 24, 12, 0.4)
    index = vector_index.build(frame(spark, matrix), str(tmp_path / "index"), cells=9)
    got = rows(index.search(frame(spark, targets, name="target"), "target", "id"))
    want = sorted(plain(targets, matrix, 5))
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want]
    assert np.allclose([r[2] for r in got], [r[2] for r in want], atol=2e-6)
    close = rows(index.search(frame(spark, targets, name="target"), "target", "id", threshold=0.9, top_k=3))
    assert [r[:2] for r in close] == [r[:2] for r in sorted(plain(targets, matrix, 3)) if r[2] >= 0.9]


@pytest.mark.parametrize("dimension", [64, 384])
def test_recall(spark, tmp_path, dimension):
    matrix, targets = corpus(2, 3000, dimension, 60, 0.6), corpus(2, 60, dimension, 60, 0.6)
    index = vector_index.build(frame(spark, matrix), str(tmp_path / "index"))
    asked = frame(spark, targets, name="target")
    exact = similarity.find_similar(asked, frame(spark, matrix), "target", "id", threshold=1e-6)
    found = index.search(asked, "target", "id", probes=6)
    assert index.cells == 54 and vector_index.recall(found, exact, "target", "id") >= 0.9


def test_added_vectors_and_a_second_batch(spark, tmp_path):
    matrix = corpus(3, 400, 16, 8, 0.4)
    path = str(tmp_path / "index")
    source = str(tmp_path / "corpus")
    frame(spark, matrix[:250]).write.parquet(source)
    vector_index.build(spark.read.parquet(source), path, cells=8)
    index = vector_index.VectorIndex(spark, path)
    index.add(frame(spark, matrix[250:], first=250))
    found = index.search(frame(spark, matrix[:30], name="target"), "target", "id")
    assert [r[:2] for r in rows(found)] == [r[:2] for r in sorted(plain(matrix[:30], matrix, 5))]
    # Only the index is read.
    assert all(path in f for f in spark.read.parquet(path + "/lists").inputFiles())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert source not in plan


def test_unfit_rows(spark, tmp_path):
    schema = "id bigint, embedding array<double>"
    given = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [0.0, 2.0])], schema)
    index = vector_index.build(given, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (None, [1.0, 0.0])], "target bigint, embedding array<double>")
    assert rows(index.search(asked, "target", "id")) == [(1, 1, 0.0, 2), (1, 4, 1.0, 1)]
    assert index.search(asked.limit(0), "target", "id").collect() == []
    with pytest.raises(ValueError):
        vector_index.build(given.limit(0), str(tmp_path / "none"))


def test_targets_of_a_cell_are_cut(spark, tmp_path, monkeypatch):
    matrix, targets = corpus(4, 300, 16, 6, 0.5), corpus(4, 90, 16, 6, 0.5)
    index = vector_index.build(frame(spark, matrix), str(tmp_path / "index"), cells=4)
    monkeypatch.setattr(vector_index, "SLICE_ROWS", 40)
    found = index.search(frame(spark, targets, name="target"), "target", "id")
    # Three slices of targets meet each slice of a cell.
    assert "part#" in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r[:2] + r[3:] for r in rows(found)] == [r[:2] + r[3:] for r in sorted(plain(targets, matrix, 5))]
