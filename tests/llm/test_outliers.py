"""Quality rules against plain counts, and the robust estimate against the same steps in numpy."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from diffloom.llm import outliers, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string"


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = collections.defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    repeated = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(8)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated)), len(lines)


def failed(counts):
    return counts[0] < 20 or 100 * counts[4] > 30 * counts[0]


def plain_verdicts(rows):
    """kept and distance of each row, by the steps of the operator over lists."""
    counted = [plain_counts(r[1]) for r in rows]
    fit = [k for k, (c, _) in enumerate(counted) if not failed(c)]
    pairs, pooled = collections.Counter(rows[k][2:4] for k in fit), collections.Counter()
    for pair, n in pairs.items():
        if n < outliers.LEAST_ROWS:
            pooled[pair[0]] += n
    cells = collections.defaultdict(list)
    for k in fit:
        pair = rows[k][2:4]
        cell = pair if pairs[pair] >= outliers.LEAST_ROWS else pair[0] if pooled[pair[0]] >= outliers.LEAST_ROWS else ("rest",)
        cells[cell].append(k)
    kept, distance = [not failed(c) for c, _ in counted], [None] * len(rows)
    spread = np.diag([(s * outliers.UNIT) ** 2 for s in outliers.COORDINATES.values()])
    whole = lambda v: math.floor(abs(v) * outliers.UNIT + 0.5) * (1 if v >= 0 else -1)
    quantile = lambda v, q: sorted(v)[math.ceil(q * len(v)) - 1]
    size, limit = len(spread), outliers.chi_square_quantile(len(spread), 1 - outliers.TAIL)
    for own in cells.values():
        if len(own) < outliers.LEAST_ROWS:
            continue
        word = {k: math.log(counted[k][0][1] / counted[k][0][0]) for k in own}
        middle = quantile([whole(w) for w in word.values()], 0.5) / outliers.UNIT
        x = []
        for k in own:
            (n, chars, symbols, dup, repeated), lines = counted[k]
            x.append([whole(v) for v in (math.log(n), (word[k] - middle) * math.sqrt(n / (n + 100)), math.log1p(100 * symbols / chars),
                                         dup / (lines + 4), repeated / n)])
        x = np.array(x, float)
        far = lambda mean, cov: np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        mean = np.array([quantile(c, 0.5) for c in x.T])
        cov = np.diag([((quantile(c, 0.75) - quantile(c, 0.25)) / 1.349) ** 2 for c in x.T]) + spread
        det = math.inf
        while True:
            bins = np.floor(outliers.BINS * np.log2(1 + far(mean, cov)))
            core = x[bins <= np.sort(bins)[math.ceil(outliers.CORE * len(x)) - 1]]
            newer = outliers.consistency(size, outliers.CORE) * np.cov(core.T, bias=True) + spread
            if np.linalg.slogdet(newer)[1] >= det - outliers.FALL:
                break
            mean, cov, det = core.mean(axis=0), newer, np.linalg.slogdet(newer)[1]
        near = x[far(mean, cov) <= outliers.chi_square_quantile(size, outliers.WEIGHTED)]
        mean, cov = near.mean(axis=0), outliers.consistency(size, outliers.WEIGHTED) * np.cov(near.T, bias=True) + spread
        for k, d in zip(own, far(mean, cov)):
            kept[k], distance[k] = bool(d <= limit), math.sqrt(d)
    return [c for c, _ in counted], kept, distance


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for i in range(400):
        text = prose(rng, rng.randint(5, 300)).replace(" ", "\n", rng.randint(0, 3))
        if i % 11 == 0:
            text = " ".join(w + "%%&" for w in text.split())
        if i % 13 == 0:
            text = " ".join(text.split()[:4] * 20)
        if i % 17 == 0:
            text += "\n" + text[: len(text) // 6] + "\nsame line\nsame line\n\t\nsame line"
        out.append((i, text, "en" if i % 4 else "de", "hot" if i % 3 else f"s{i % 5}"))
    out += [(500, None, "en", "hot"), (501, "", None, None), (502, " \t\r\n", "en", None), (None, out[1][1], None, "hot"), out[2], out[2],
            (503, prose(rng, 30000), "en", "hot"), (504, "é ü " * 3 + prose(rng, 50), "null", "hot"), (505, "w " * 7, "en", "hot")]
    return out


def test_counts(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(r["doc_id"], r["n_words"]): tuple(r[c] for c in (*outliers.STATISTICS, "n_lines")) for r in outliers.statistics(frame).collect()}
    assert got == {(r[0], plain_counts(r[1])[0][0]): (*plain_counts(r[1])[0], plain_counts(r[1])[1]) for r in rows}


@pytest.mark.parametrize("few", [True, False])
def test_verdicts(spark, rows, monkeypatch, few):
    monkeypatch.setattr(outliers, "BROADCAST_GROUPS", 50_000 if few else 0)
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("pair", "cell", "n", "d", "n_words", "kept", "_salt")})
    got = sorted(outliers.quality_rules(frame.repartition(3)).collect(), key=str)
    counts, kept, distance = plain_verdicts(rows)
    want = sorted(zip([r[0] for r in rows], counts, kept, distance), key=lambda r: (str(r[0]), r[1]))
    got = sorted(got, key=lambda r: (str(r["doc_id"]), tuple(r[c] for c in outliers.STATISTICS)))
    assert [(r["doc_id"], tuple(r[c] for c in outliers.STATISTICS), r["base_failed"], r["kept"]) for r in got] == [
        (i, c, failed(c), k) for i, c, k, _ in want]
    for row, (_, _, _, d) in zip(got, want):
        assert row["distance"] == (None if d is None else pytest.approx(d, rel=1e-6))
    # Some rows are outliers, and most others are not.
    base = sum(not failed(c) for c in counts)
    assert 0.5 * base < sum(kept) < base


def test_small_and_empty_tables(spark):
    assert outliers.quality_rules(spark.createDataFrame([], SCHEMA)).collect() == []
    rng = random.Random(1)
    few = [(i, prose(rng, 30) + " " + "%" * i, "en", "a") for i in range(20)]
    assert all(r["kept"] and r["distance"] is None for r in outliers.quality_rules(spark.createDataFrame(few, SCHEMA)).collect())


def test_equal_rows_have_an_estimate(spark):
    rng = random.Random(2)
    text = prose(rng, 80)
    rows = [(i, text, "en", "a") for i in range(90)] + [(100, " ".join(w + "$$$" for w in text.split()), "en", "a")]
    got = {r["doc_id"]: r["kept"] for r in outliers.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not got[100] and all(got[i] for i in range(90))


def test_chi_square():
    # Values of printed tables.
    assert outliers.chi_square_quantile(5, 0.975) == pytest.approx(12.8325, abs=1e-4)
    assert outliers.chi_square_quantile(7, 0.5) == pytest.approx(6.3458, abs=1e-4)
    assert outliers.chi_square(2, 5.9915) == pytest.approx(0.95, abs=1e-5)


def test_query_on_labelled_rows(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.op12_robust_outliers(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    shares = {r["quality"]: r["share"] for r in found.where("n_words >= 20").groupBy("quality").agg(
        F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert shares[1] > 0.97 and shares[0] < 0.1
