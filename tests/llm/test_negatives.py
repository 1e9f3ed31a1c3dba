"""Hard negatives against a plain scan of all scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from diffloom.llm import negatives, queries
from oracle_check import differences, open_tables

SCHEMA = "vec_id bigint, label int, embedding array<float>"


def plain(rows, positives=5, wanted=3, low=50, high=95):
    fit = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows
           if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)]
    asking = {}
    for i, label, v in fit:
        if i % 50 == 0:
            asking[i] = min(asking.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in asking.items():
        scored = [(max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(v, w)))), i, other) for i, other, w in fit if i != a]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for score, p, _ in [s for s in scored if s[2] == label][:positives]:
            near = [s for s in scored if s[2] != label and low * score <= 100 * s[0] <= high * score]
            out += [(a, p, k + 1, n[1], score, n[0]) for k, n in enumerate(near[:wanted])]
    return sorted(out)


def mined(spark, rows, **more):
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("place", "score", "slot", "block", "rank")})
    found = negatives.hard_negatives(frame.repartition(3), F.col("vec_id") % 50 == 0, **more)
    return sorted(tuple(r) for r in found.collect())


def vectors(seed, n, width, spread=1.0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(3, width))
    return [(i, int(i % 4), [float(np.float32(x)) for x in spread * (centre[i % 3] + 0.5 * rng.normal(size=width))]) for i in range(n)]


def test_against_a_scan(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 64)
    monkeypatch.setattr(negatives, "CELL_BLOCKS", 2)
    rows = vectors(1, 700, 8)
    # Ties, copies, a third of all rows under one label, negative and zero scores.
    rows += [(1000 + i, 7, rows[3][2]) for i in range(120)] + [(2000 + i, 0, rows[100][2]) for i in range(350)]
    rows += [(3000, 0, [0.0] * 8), (3050, 2, [-x for x in rows[50][2]]), (3100, 9, [1.0] * 8)]
    random.Random(4).shuffle(rows)
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, rows, positives=2, negatives=7, low=0, high=100) == plain(rows, 2, 7, 0, 100)


def test_awkward_rows(spark):
    rows = vectors(2, 120, 4)
    rows += [(None, 1, [1.0] * 4), (200, None, [1.0] * 4), (201, 1, None), (202, 1, [1.0, None, 0.0, 0.0]), (203, 1, [math.nan] * 4),
             (250, 1, [math.inf, 0.0, 0.0, 0.0]), (204, 3, []), (205, 1, [0.5]), (300, 1, [0.5, 0.25]), (206, 2, [1.0] * 6)]
    rows += [rows[7], rows[7], rows[50], (50, 0, rows[50][2])]
    assert mined(spark, rows) == plain(rows)


def test_scores_beyond_doubles(spark):
    rows = [(i, i % 2, [float(np.float32(3e7 * x)) for x in v]) for i, _, v in vectors(3, 60, 4)]
    rows += [(100, 0, [1e30, 1.0, 0.0, 0.0]), (101, 0, [1.0, 1.0, 1.0, 1.0]), (102, 1, [0.5, 1.0, 1.0, 1.0])]
    rows = [(i, label, [float(np.float32(x)) for x in v]) for i, label, v in rows]
    assert mined(spark, rows) == plain(rows)


def test_nothing_to_mine(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == []
    assert mined(spark, [(50, 1, [1.0]), (2, 2, [1.0])]) == []
    with pytest.raises(ValueError):
        mined(spark, [], low=60, high=50)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_matches_sql(spark, folder):
    expected = open_tables(folder).sql(queries.ORACLE_SQL["op13_hard_negatives"])
    assert differences(queries.op13_hard_negatives(spark, folder), expected) == []
