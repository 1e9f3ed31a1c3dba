"""Periodic runs against a plain scan of every period, and the query against the rules it stands for."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from diffloom.llm import queries, runs

SF = "/root/testdata/sf0.001"


def plain_runs(words, least=6, powers=4):
    n, found = len(words), {}
    for q in range(1, n // powers + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, powers * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((start, length, q) for (start, length), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_find_runs():
    rng = random.Random(1)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 6)):
            letters = rng.choice([1, 2, 2, 3, 5, 50])
            text = [rng.randrange(letters) for _ in range(rng.randint(0, 60))]
            for _ in range(rng.randint(0, 3)):
                root = [rng.randrange(letters) for _ in range(rng.randint(1, 12))]
                at = rng.randint(0, len(text))
                text[at:at] = (root * rng.randint(1, 9))[: rng.randint(1, 90)]
            texts.append(text)
        found = runs.find_runs(np.array([w for t in texts for w in t], np.int64), np.array([len(t) for t in texts]))
        assert [tuple(r) for r in found.tolist()] == [(k, *r) for k, t in enumerate(texts) for r in plain_runs(t)]


def test_periodic_words():
    before, word = [0], [0, 1]
    while len(word) < 400:
        before, word = word, word + before
    ruler = [(i & -i).bit_length() for i in range(1, 300)]
    for text in (word, ruler, word + word[:150] * 5, [1] * 500 + [2] + [1] * 500):
        found = runs.find_runs(np.array(text), np.array([len(text)]))
        assert [tuple(r[1:]) for r in found.tolist()] == plain_runs(text)


def test_long_text_in_little_time():
    root = list(range(7))
    found = runs.find_runs(np.array((root * 30000)[:200000]), np.array([200000]))
    assert found.tolist() == [[0, 0, 200000, 7]]


def test_tree():
    rng = np.random.default_rng(2)
    values = rng.permutation(300)
    tree = runs.WaveletTree(values, 9)
    low = rng.integers(0, 299, 200)
    high = np.minimum(low + rng.integers(1, 90, 200), 300)
    bound = rng.integers(0, 300, 200)
    assert tree.below(low, high, bound).tolist() == [int((values[a:b] < x).sum()) for a, b, x in zip(low, high, bound)]
    n = (high - low) // 2
    assert tree.nth(low, high, n).tolist() == [int(np.sort(values[a:b])[k]) for a, b, k in zip(low, high, n)]


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\r\n"), (None, "a " * 9), (5, "a b\x0ba b a\nb a  b x"), (5, "a b\x0ba b a\nb a  b x"),
            (6, "é é " * 8), (7, "one two three four five six"), (8, "x y " * 40000)]
    docs = spark.createDataFrame([(i, t, "n", "r") for i, t in rows], "doc_id bigint, text string, runs string, n_words string")
    got = sorted(runs.periodic_runs(docs.repartition(3)).collect(), key=lambda r: str(r["doc_id"]))
    want = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        found = plain_runs(words) if len(words) < 1000 else [(0, 80000, 2)]
        want.append((doc_id, len(words), found, collapsed(words, found)))
    assert got == sorted(want, key=lambda r: str(r[0]))


def test_empty_table(spark):
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_fewer_powers_are_refused(spark):
    with pytest.raises(ValueError):
        runs.find_runs(np.array([1, 1, 1]), np.array([3]), powers=3)


def test_query(spark):
    """The whole table by the rules of the query, word by word."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op11_period_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    assert sum(r["n_runs"] > 0 for r in got.values()) > 5
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = plain_runs(words)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        row = got[doc_id]
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(found), *best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        assert row["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(collapsed(words, found).encode()).hexdigest()
