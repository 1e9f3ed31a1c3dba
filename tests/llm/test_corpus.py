"""Corpus operators against brute force on small, awkward tables."""

import collections
import hashlib
import html
import itertools
import math
import os
import random
import re
import tempfile
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from diffloom import session
from diffloom.llm import blocks, components, ctw, decontam, exact, extract, jaccard, kneser, licenses, materialise, mixing, queries, suffix
from diffloom.operators import ordering

SF = "/root/testdata/sf0.001"
BLANK_SPLIT = r"[^\x20\x09-\x0D]+"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(BLANK_SPLIT, lowered(text))


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, null ids and texts, a repeated row, equal ids, a very long text, other scripts."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 90))) for _ in range(40)]
    out = list(enumerate(texts))
    out += [(100 + i, texts[i].upper()) for i in range(5)] + [(200 + i, texts[0]) for i in range(30)]
    for i in range(60):
        near = texts[7].split()
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(len(near))] = f"n{rng.randrange(999)}"
        out.append((300 + i, " ".join(near)))
    out += [(None, texts[3]), (None, None), (5, texts[9]), (6, None), (7, ""), (8, " \t\n"), (400, "a b"), (401, "A  b\n")]
    out += [(402, "ab" * 400), (403, "ab" * 30), (404, "ü É ñ " * 30), (405, " ".join(rng.choices(vocabulary, k=30000)))]
    out += [(406, texts[4][:120] + " x " + texts[5][:49]), out[0], out[0]]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    # Extra columns with names that operators use themselves.
    return frame.withColumns({c: F.lit("x") for c in ("size", "n", "key", "block_id", "shard", "words", "lang")}).withColumn(
        "source", F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "b"))


def test_exact_duplicates(docs, rows):
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[lowered(text)].append(doc_id)
    expected = []
    for doc_id, text in rows:
        group = groups[lowered(text)]
        keep = max((i for i in group if i is not None), default=None)
        expected.append((doc_id, keep, len(group), doc_id == keep, hashlib.sha256(lowered(text).encode()).hexdigest()))
    assert ordered(exact.exact_duplicates(docs).collect()) == ordered(expected)


def test_repeated_passages(docs, rows):
    small = [r for r in rows if len(r[1] or "") < 5000]
    order = lambda i: -(10**20) if i is None else i
    first = {}
    for doc_id, text in small:
        body = (text or "").encode()
        for i in range(len(body) - 49):
            window = body[i : i + 50]
            first[window] = min(first.get(window, 10**20), order(doc_id))
    expected = []
    for doc_id, text in small:
        body = (text or "").encode()
        gone = bytearray(len(body))
        for i in range(len(body) - 49):
            if first[body[i : i + 50]] < order(doc_id):
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(body, gone) if not g)
        expected.append((doc_id, len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    got = suffix.repeated_passages(docs.where(F.length(F.coalesce("text", F.lit(""))) < 5000))
    assert ordered(got.collect()) == ordered(expected)


def test_segments_do_not_change_stretch_windows(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    ends = np.array([1000, 1010, 5000])
    starts = np.array([0, 1000, 1010])

    def covered():
        return sorted(int(w) + at for at, _, a, b, _ in suffix.stretches(data, starts, ends, 50) for x, y in zip(a, b) for w in range(x, y + 1))

    whole = covered()
    monkeypatch.setattr(suffix, "SEGMENT", 333)
    assert covered() == whole == [i for s, e in zip(starts, ends) for i in range(s, e - 49)]


def test_index_family_merges_geometrically():
    family = suffix.IndexFamily()
    for k in range(64):
        family.add(suffix.Level(np.arange(k * 10, k * 10 + 10, dtype=np.uint64), np.zeros(10, np.uint64)))
    assert len(family.levels) <= 7
    assert family.scan(np.array([0, 639, 640], np.uint64)).tolist() == [True, True, False]
    assert family.shared_keys().tolist() == [0]


def brute_components(rows, size, percent):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            parent[find(j)] = find(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        key = blocks.NULL_ID if doc_id is None else doc_id
        least[find(i)] = min(least.get(find(i), key), key)
    return [(r[0], len(s), None if least[find(i)] == blocks.NULL_ID else least[find(i)]) for i, (r, s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("block_docs", [2048, 8])
def test_jaccard_components(docs, rows, block_docs):
    got = jaccard.jaccard_components(docs, 4, 85, block_docs)
    assert ordered(got.collect()) == ordered(brute_components(rows, 4, 85))


@pytest.mark.parametrize("block_docs", [2048, 8])
def test_jaccard_links_are_all_counted(docs, rows, block_docs):
    def shingles(text):
        w = words(text)
        return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])

    def near(a, b):
        return a and b and 100 * len(a & b) >= 85 * len(a | b)

    sets = [shingles(t) for _, t in rows]
    expected = [(r[0], sum(bool(near(a, b)) for j, b in enumerate(sets) if j != i)) for i, (r, a) in enumerate(zip(rows, sets))]
    assert ordered(jaccard.jaccard_links(docs, 4, 85, block_docs).select("doc_id", "n_links").collect()) == ordered(expected)
    least = {}
    for (doc_id, _), a in zip(rows, sets):
        least[a] = min(least.get(a, 10**9), -1 if doc_id is None else doc_id)
    pairs = [tuple(sorted((least[a], least[b]))) for a, b in itertools.combinations(least, 2) if near(a, b)]
    got = jaccard.jaccard_pairs(docs, 4, 85, block_docs).collect()
    assert ordered(tuple(None if i == -1 else i for i in p) for p in pairs) == ordered(got)


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(90, 90), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 90: 90}


def brute_kept(rows, size, percent):
    """Rows alike are one; of each group of linked rows the first by doc_id (none: last), then MD5 of the text, stays."""
    rows = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    texts = [words(t) for _, t in rows]
    sets = [{tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()) for w in texts]
    kept, seen = [], set()
    for k, row in enumerate(rows):
        if k in seen:
            continue
        kept.append(row)
        todo = [k]
        while todo:
            a = sets[todo.pop()]
            for j, b in enumerate(sets):
                if j not in seen and a and b and 100 * len(a & b) >= percent * len(a | b):
                    seen.add(j)
                    todo.append(j)
    return kept


def test_without_copies_keeps_one_of_each_group(spark, docs, rows):
    kept = jaccard.without_copies(docs, 5, 80).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert ordered(kept) == ordered(brute_kept(rows, 5, 80))


def test_without_copies_tells_rows_apart_by_text(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, " ".join(f"v{i}" for i in range(60))), (7, text), (None, text + " end"), (None, "begin " + text)]
    kept = jaccard.without_copies(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 80).collect()
    assert ordered(kept) == ordered(rows[:2])


def test_near_copies_make_rows_in_proportion(spark, monkeypatch):
    """A group of near copies must not leave the products as its pairs."""
    made = []
    monkeypatch.setattr(jaccard, "checkpointed", lambda df: made.append(blocks.checkpointed(df)) or made[-1])
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i in range(300) for k in [rng.randrange(200)]]
    found = jaccard.jaccard_links(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 85, 1000)
    assert {(r.component_id, r.n_links) for r in found.collect()} == {(0, 299)}
    sums = [df for df in made if "met" in df.columns]
    assert len(sums) == 1 and sums[0].count() == 300


def brute_ctw(rows, depth):
    def steps(text):
        body = b"\n" * depth + " ".join(words(text)).encode() + b"\n"
        for i in range(depth, len(body)):
            for k in range(8):
                yield body[i - depth : i], (256 | body[i]) >> (8 - k), (body[i] >> (7 - k)) & 1

    counts = collections.defaultdict(lambda: [0, 0])
    for doc_id, text in rows:
        if not ctw.held_out_id(doc_id):
            for context, so_far, bit in steps(text):
                for d in range(depth + 1):
                    counts[context[depth - d :], so_far][bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    longer = collections.defaultdict(list)
    for context, so_far in counts:
        if context:
            longer[context[1:], so_far].append((context, so_far))
    memo = {}

    def weighted(node):
        if node not in memo:
            own = kt(*counts[node])
            if len(node[0]) < depth:
                below = sum(map(weighted, longer[node]))
                top = max(own, below)
                own = top + math.log((math.exp(own - top) + math.exp(below - top)) / 2)
            memo[node] = own
        return memo[node]

    def chance(context, so_far, bit, d=0):
        node = (context[depth - d :], so_far)
        if node not in counts:
            return 0.5
        pair = counts[node]
        own = (pair[bit] + 0.5) / (sum(pair) + 1)
        if d == depth:
            return own
        weight = math.exp(kt(*pair) - weighted(node)) / 2
        return weight * own + (1 - weight) * chance(context, so_far, bit, d + 1)

    return [sum(math.log10(chance(*s)) for s in steps(text)) for _, text in rows]


def test_context_tree_scores(spark, rows):
    small = [(i, (t or "")[:160] if t else t) for i, t in rows if i is not None][:60] + [(None, "abc"), (9001, None)]
    frame = spark.createDataFrame(small, "doc_id bigint, text string").repartition(3)
    got = ordered(ctw.context_tree_scores(frame, 3).collect())
    known = collections.Counter()
    for doc_id, text in small:
        if not ctw.held_out_id(doc_id):
            known.update([*words(text), None])
    n, v = sum(known.values()), len(known)
    expected = []
    for (doc_id, text), score in zip(small, brute_ctw(small, 3)):
        tokens = [*words(text), None]
        base = sum(math.log10((known[t] + 1) / (n + v + 1)) for t in tokens)
        expected.append((doc_id, ctw.held_out_id(doc_id), len(tokens), sum(known[t] > 0 for t in tokens), n, base, score))
    for a, b in zip(got, ordered(expected)):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9)
        assert a[6] == pytest.approx(b[6], abs=3e-4 * 8 * 160)


def test_context_tree_beats_words_on_held_out_text(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 3000").repartition(8)
    held = ctw.context_tree_scores(frame).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_log_gamma():
    for x in (0.5, 1.0, 1.5, 7.0, 123.5, 1e6):
        assert ctw.log_gamma(np.array([x]))[0] == pytest.approx(math.lgamma(x), abs=1e-9, rel=1e-12)


def test_mixing_reaches_targets(docs, rows):
    got = mixing.mix_sources(docs, block_words=4).collect()
    assert len(got) == len(rows)
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    weights = {"a": 5, "b": 2, None: 1}
    expected, capped = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        share = sum(w for s, w in weights.items() if s not in capped)
        expected = {s: 3 * sizes[s] if s in capped else left * w / share for s, w in weights.items()}
        over = {s for s in weights if s not in capped and expected[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in weights:
        assert target[s] == pytest.approx(expected[s])
        assert abs(taken[s] - target[s]) <= 8
    assert ordered(got) == ordered(mixing.mix_sources(docs, block_words=4).collect())


def test_seats_are_the_highest_quotients(spark):
    targets = [("a", 53.0), ("b", 24.0), ("c", 23.0), ("d", 0.0), ("e", 2.5)]
    frame = spark.createDataFrame([(s, i + 1, t) for i, (s, t) in enumerate(targets)], "source string, source_rank bigint, target double")
    got = {(r.house, r.source): r.seats for r in mixing.seats(frame, [1, 2, 7, 100]).collect()}
    for house in (1, 2, 7, 100):
        quotients = sorted(((-t / (2 * k - 1), i) for i, (_, t) in enumerate(targets) if t for k in range(1, house + 1)))[:house]
        won = collections.Counter(targets[i][0] for _, i in quotients)
        assert {s: got[house, s] for s, _ in targets} == {s: won[s] for s, _ in targets}


def test_mixed_texts_take_what_the_plan_says(docs):
    plain = docs.select("doc_id", "text", "source", "lang", F.lit(1).cast("bigint").alias("n_chars"))
    taken = {r[0]: r[1] for r in mixing.mix_sources(plain, block_words=8).groupBy("source").agg(F.sum("taken")).collect()}
    texts = mixing.mixed_texts(plain, block_words=8)
    assert texts.columns == plain.columns
    got = {r[0]: r[1] for r in texts.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).collect()}
    assert got == {s: n for s, n in taken.items() if n}


def test_the_mix_places_rows_without_their_texts(docs, monkeypatch):
    """Whole texts are not written while rows are placed."""
    written, keep = [], mixing.checkpointed
    for module in (mixing, ordering):
        monkeypatch.setattr(module, "checkpointed", lambda frame: written.append(frame.schema.simpleString()) or keep(frame))
    got = mixing.mixed_texts(docs, block_words=8)
    assert len(written) > 3 and all("doc_id" not in names or "text:" not in names for names in written) and got.count() > 0


def test_repeated_rows_of_the_mix_keep_their_texts(spark, monkeypatch):
    """Rows that share a doc_id, a text or both, or have no doc_id, are rows of their own, however often they come."""
    rows = [(i % 7 if i % 5 else None, " ".join(f"w{i % 11}x{k}" for k in range(i % 9 + 1)), f"s{i % 2}", "en" if i % 3 else None) for i in range(90)]
    rows += rows[:20] * 6 + [(1, None, "s0", "en"), (2, " \n", "s1", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").coalesce(1)
    taken = mixing.mix_sources(docs, block_words=4).groupBy("doc_id", "source").agg(F.sum("taken").alias("n")).where("n > 0")
    found = []
    for repeats in (mixing.REPEATS, 2):
        monkeypatch.setattr(mixing, "REPEATS", repeats)
        got = mixing.mixed_texts(docs, block_words=4).collect()
        found.append(sorted(map(repr, got)))
        assert all(any(set(r.text.split()) <= set(row[1].split()) for row in rows if row[1] and (row[0], *row[2:]) == (r.doc_id, r.source, r.lang)) for r in got)
        words = collections.Counter()
        for r in got:
            words[r.doc_id, r.source] += len(r.text.split())
        assert words == {(r.doc_id, r.source): r.n for r in taken.collect()}
    assert found[0] == found[1]


def norm(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_decontamination(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(200)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([40, 25, 20, 14, 10, 6, 3, 1])]
    items += [(90, items[0][1]), (91, None), (92, "")]
    docs = [(i, " ".join(rng.choices(vocabulary, k=80))) for i in range(20)] + [(50, None), (51, ""), (None, items[1][1])]
    for i, text in items[:6]:
        w = norm(text)
        for changes in (0, max(1, len(w) // 10), len(w) // 5, len(w) // 2):
            new = list(w)
            for at in rng.sample(range(len(w)), changes):
                new[at] = f"s{at}"
            docs.append((1000 + 10 * i + changes, " ".join([*rng.choices(vocabulary, k=5), *new, *rng.choices(vocabulary, k=5)])))
    docs += [(2000, items[0][1][len(items[0][1]) // 3 :]), docs[-1]]
    expected = set()
    for doc_id, text in docs:
        w = norm(text)
        for item, body in items:
            x = norm(body)
            for start in range(-len(x), len(w) + 1):
                same = [w[start + k] == x[k] for k in range(len(x)) if 0 <= start + k < len(w)]
                width = min(len(x), 20)
                need = width if len(x) < decontam.REACH else math.ceil(width * 0.8)
                if x and any(sum(same[a : a + width]) >= need for a in range(len(same) - width + 1)):
                    expected.add((doc_id, item))
    got = decontam.contaminated(
        spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("words", F.lit(1)),
        spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == expected


def test_decontamination_with_more_seeds_than_tasks_can_hold(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=12 + i % 20))) for i in range(60)] + [(70, "v1 v2 v3"), (71, "v1 v2 v3 v4 v5")]
    docs = [(i, " ".join([*rng.choices(vocabulary, k=30), items[i % 62][1], "end"])) for i in range(80)]
    # One id for two texts, texts without an id, and a row that comes twice.
    docs += [(3, items[9][1]), (None, items[10][1]), (None, items[11][1]), docs[0]]
    rows, benchmark = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    expected = sorted(map(tuple, decontam.contaminated(rows, benchmark).collect()), key=str)
    assert {(3, 3), (3, 9), (None, 10), (None, 11), (70, 8)} <= {x[:2] for x in expected}
    # A filter of 64 rows lets most words through, and seeds meet them by shuffle.
    monkeypatch.setattr(decontam, "SENT_SEEDS", 0)
    monkeypatch.setattr(decontam, "FILTER_ROWS", 64)
    sent = []
    monkeypatch.setattr(decontam, "checkpointed", lambda df: sent.append(df.columns) or session.checkpointed(df))
    got = sorted(map(tuple, decontam.contaminated(rows, benchmark).collect()), key=str)
    assert got == expected
    # What hits pass on are hashes and places, no words.
    assert sent[-1] == ["doc_id", "text_key", "item", "doc_at"]


def test_masks_hit_every_tolerated_pattern():
    for length, changes in ((20, 4), (14, 2), (10, 2)):
        for bad in itertools.combinations(range(length), changes):
            assert any(all(s + o not in bad for o in m) for m in decontam.MASKS for s in range(length - m[-1]))


def test_license_scan(spark):
    filler = " ".join(f"f{i}" for i in range(100))
    docs = [(i, f"{filler[: 7 * i]} {text}\n{filler}") for i, text in enumerate(licenses.TEMPLATES.values())]
    docs += [(100, filler), (101, None), (102, "Released under the MIT"), (None, "released UNDER the mit license")]
    got = licenses.license_matches(spark.createDataFrame(docs, "doc_id bigint, text string"), licenses.default_templates(spark)).collect()
    assert {(r.doc_id, r.license) for r in got} == {*enumerate(licenses.TEMPLATES), (None, "MIT")}
    assert all(r.containment == 1.0 for r in got)


def test_license_scan_knows_notices_and_whole_texts(spark):
    filler = " ".join(f"f{i}" for i in range(100))
    gpl = ("This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as "
           "published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.")
    docs = {
        1: ("GPL-3.0", gpl), 2: ("MIT", "This project is licensed under the MIT License."),
        3: ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
        4: ("GPL-3.0", (licenses.TEXTS / "GPL-3.0.txt").read_text()), 5: ("LGPL-3.0", (licenses.TEXTS / "LGPL-3.0.txt").read_text()),
        6: ("MIT", "// SPDX-License-Identifier: MIT"), 7: ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-or-later */"),
        8: ("LGPL-2.1", gpl.replace("General", "Lesser General").replace("program", "library").replace("version 3", "version 2.1")),
    }
    frame = spark.createDataFrame([(i, f"{filler}\n{t}\n{filler}") for i, (_, t) in docs.items()], "doc_id bigint, text string")
    got = licenses.license_matches(frame, licenses.default_templates(spark)).collect()
    assert {(r.doc_id, r.license) for r in got} == {(i, name) for i, (name, _) in docs.items()}
    assert all(r.at >= 100 for r in got)


def test_kneser_ney_sums_to_one(spark):
    model = kneser.train(spark.createDataFrame([("a b a c a b d a b c d e f f f",), ("b a c d d a b e",), (None,)], "text string"))
    tokens, counts = kneser._token_rows([b"a b " + w for w in (b"a", b"b", b"c", b"d", b"e", b"f", b"zzz")] + [b"a b"])
    logs = np.split(model.log_chances(tokens, counts), np.cumsum(counts)[:-1])
    # All known words and the end, and one unknown word for the rest.
    assert sum(math.exp(x[2]) for x in logs) == pytest.approx(1.0, abs=1e-5)


def brute_perplexity(train, text):
    """Interpolated modified Kneser-Ney over dictionaries, one token at a time."""
    def tokens(t):
        return ["<", "<", *re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+", (t or "").encode().lower()), ">"]

    triples = Counter(g for t in train for ts in [tokens(t)] for g in zip(ts, ts[1:], ts[2:]))
    pairs = Counter(g[1:] for g in triples)
    words = Counter(g[1:] for g in pairs)

    def level(counts):
        n = [sum(v == k for v in counts.values()) for k in range(1, 5)]
        d = [0.5, 1.0, 1.5]
        if all(n[:3]):
            y = n[0] / (n[0] + 2 * n[1])
            d = [x if 0 < x <= k + 1 else d[k] for k in range(3) for x in [k + 1 - (k + 2) * y * n[k + 1] / n[k]]]
        total, left = Counter(), Counter()
        for g, v in counts.items():
            total[g[:-1]] += v
            left[g[:-1]] += d[min(v, 3) - 1]

        def chance(g, below):
            if g[:-1] not in total:
                return below
            own = counts[g] - d[min(counts[g], 3) - 1] if g in counts else 0
            return (own + left[g[:-1]] * below) / total[g[:-1]]

        return chance

    one, two, three = level(words), level(pairs), level(triples)
    ts = tokens(text)
    logs = [math.log(three(g, two(g[1:], one(g[2:], 1 / (len(words) + 1))))) for g in zip(ts, ts[1:], ts[2:])]
    return math.exp(-sum(logs) / len(logs))


@pytest.mark.parametrize("model_rows", [kneser.MODEL_ROWS, 0], ids=["in tasks", "joined"])
def test_perplexity_equals_brute_force_with_models_of_any_size(spark, docs, model_rows):
    texts = [r.text for r in docs.orderBy("doc_id").select("text").limit(60).collect()]
    train, asked = texts[:40], [*texts[40:], *texts[:3], None, "", " \n", "Zzz qqq!", "a " * 3000, texts[41]]
    model = kneser.train(spark.createDataFrame([(t,) for t in train], "text string"), model_rows)
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(asked)], "doc_id bigint, text string, _row string").repartition(3)
    got = {r.doc_id: r for r in kneser.perplexities(rows, model, ["doc_id", "text"]).collect()}
    assert len(got) == len(asked)
    for i, text in enumerate(asked):
        assert got[i].text == text and got[i].perplexity == pytest.approx(brute_perplexity(train, text), rel=1e-4)
    assert kneser.perplexities(rows.limit(0), model, ["doc_id"]).count() == 0


def test_a_large_model_in_lots_gives_the_same_and_is_kept_packed(spark, docs, monkeypatch):
    """Counting and scoring lot by lot, over more than one shard, against the model in tasks; no more than packed tables is kept."""
    texts = [r.text for r in docs.orderBy("doc_id").select("text").limit(60).collect()]
    train = spark.createDataFrame([(t,) for t in texts[:40]], "text string")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts[30:], *texts[:5], None, "", "Zzz qqq!"])], "doc_id bigint, text string")
    whole = {r.doc_id: r.perplexity for r in kneser.perplexities(rows, kneser.train(train), ["doc_id"]).collect()}
    monkeypatch.setattr(kneser, "FIT_LOT_BYTES", 300)
    monkeypatch.setattr(kneser, "SCORE_LOT_BYTES", 300)
    model = kneser.train(train, 0)
    got = {r.doc_id: r.perplexity for r in kneser.perplexities(rows, model, ["doc_id"]).collect()}
    assert got.keys() == whole.keys() and all(got[i] == pytest.approx(whole[i], rel=1e-4) for i in whole)
    # A row of five columns and a count took 48 bytes and more for each triple.
    many = spark.range(50).select(F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(8000)), lambda k: F.pmod(F.xxhash64("id", k), F.lit(20011)).cast("string"))).alias("text"))
    model = kneser.train(many, 0)
    kept = sum(os.path.getsize(f"{at}/{f}") for path in model.paths for at, _, names in os.walk(path.removeprefix("file:")) for f in names)
    assert model.rows > 700_000 and kept < 20 * model.rows


def test_long_trusted_texts_are_fitted_whole(spark):
    # 25 texts of 20,000 words and almost as many distinct triples: above the bound of a model in tasks.
    row = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(20000)), lambda k: F.pmod(F.xxhash64("doc_id", k), F.lit(30011)).cast("string")))
    docs = spark.range(25).select(F.col("id").alias("doc_id"), row.alias("text"), F.lit("en").alias("lang"))
    model = kneser.train(docs, 1_000_000)
    assert isinstance(model, kneser.ShardedModel) and model.rows > 1_000_000
    got = kneser.perplexities(docs, model, ["doc_id"]).collect()
    assert len(got) == 25 and all(r.n_tokens == 20001 and math.isfinite(r.perplexity) for r in got)


def test_quality_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = kneser.quality_scores(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("accepted").cast("int"))).collect()
    share = {r[0]: r[1] for r in got}
    assert share[1] > 0.97 and share[0] < 0.3
    bare = spark.createDataFrame([(None, None, None), (1, "a b", "en"), (1, "a b", "en")], docs.select("doc_id", "text", "lang").schema)
    assert kneser.quality_scores(bare, labels.limit(0)).where("accepted").count() == 3


def test_permutation_is_one_to_one():
    for size in (1, 2, 3, 10, 257, 1000, 4096):
        assert sorted(materialise.permuted(np.arange(size), size, 7)) == list(range(size))
    assert list(materialise.permuted(np.arange(1000), 1000, 7)) != list(materialise.permuted(np.arange(1000), 1000, 8))


def test_shards_round_trip(spark, docs, rows):
    tokenizer = materialise.Tokenizer()
    folder = tempfile.mkdtemp(prefix="shards-")
    sequences = materialise.training_order(docs, tokenizer, length=64, per_shard=50).cache()
    manifest = materialise.write_shards(sequences, folder).collect()
    total = sequences.count()
    assert sorted(r.slots for r in manifest)[1:] == [50] * (len(manifest) - 1) and sum(r.slots for r in manifest) == total
    back = {r.slot: r.tokens for r in materialise.read_shards(spark, folder, 64, 50).collect()}
    stream = [t for r in sequences.orderBy("sequence").collect() for t in back[r.slot][: r.n_tokens]]
    texts, current, encoder = [], [], tokenizer.encoder()
    for token in stream:
        if token == tokenizer.end:
            texts.append(encoder.decode(current))
            current = []
        else:
            current.append(token)
    assert sorted(texts) == sorted(t or "" for _, t in rows)
    assert materialise.read_shards(spark, folder, 64, 50, from_slot=70).count() == total - 70


def test_training_order_query_leaves_files_to_resume_from(spark, monkeypatch):
    folder = tempfile.mkdtemp(prefix="shards-")
    monkeypatch.setattr(queries, "scratch_path", lambda _, name: f"{folder}/{name}")
    rows = queries.op8_training_order(spark, SF)
    assert "ids" not in rows.columns
    rows = rows.collect()
    back = materialise.read_shards(spark, f"{folder}/shards")
    assert sorted(r.slot for r in back.select("slot").collect()) == sorted(r.slot for r in rows) == list(range(len(rows)))
    assert all(r.file == f"shard-{r.shard:06d}.bin" and r.offset == r.slot % materialise.SHARD_SLOTS * 2 * materialise.SEQUENCE for r in rows)


def test_shards_in_lots_are_those_of_one_shuffle(spark, docs):
    """Rows and files of all lots are those of one lot."""
    one, many = (tempfile.mkdtemp(prefix="shards-") for _ in range(2))
    whole = materialise.written(materialise.training_order(docs, length=64, per_shard=50), one).collect()
    before = spark.conf.get(session.SHUFFLE_CLEANUP)
    rows = materialise.written_in_lots(docs, many, length=64, per_shard=50, lots=3)
    assert spark.conf.get(session.SHUFFLE_CLEANUP) == before
    assert sorted(rows.collect(), key=lambda r: r.slot) == sorted(whole, key=lambda r: r.slot) and len({r.shard for r in whole}) > 3
    names = sorted(os.listdir(one))
    assert names == sorted(os.listdir(many)) and all(open(f"{one}/{n}", "rb").read() == open(f"{many}/{n}", "rb").read() for n in names)
    assert materialise.written_in_lots(docs.limit(0), tempfile.mkdtemp(prefix="shards-")).count() == 0


def test_what_is_stored_leaves_no_shuffle_files(spark, tmp_path):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        listed = manager.getAllFiles()
        return {name for name in (listed.apply(k).getName() for k in range(listed.size())) if name.startswith("shuffle_")}

    before = files()
    path = session.stored(spark.range(1000).repartition(7, "id"), "numbers")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and spark.read.parquet(path).count() == 1000
    session.dropped(spark, path)
    assert not os.path.exists(path.removeprefix("file:"))


def test_each_partition_of_the_training_order_is_one_shard(docs):
    parts = materialise.training_order(docs, length=64, per_shard=50).select("shard", F.spark_partition_id().alias("part")).distinct().collect()
    assert len(parts) > 2 and all(r.shard == r.part for r in parts)


def test_main_text():
    page = """<html><head><title>T</title></head><body><header>Logo</header><div id="cookie-notice">We use cookies</div>
    <div class=wrap><div class="content"><h2>Title &amp; more</h2><p>First  para with <a href=a>a link</a> and text.
    <p>Second<br>line<script>var x = "<p>no</p>";</script><ul><li>one<li>two</ul><div class="share">Share</div></div>
    <div class="sidebar"><p>Side text side text</p></div></div><section id=comments><p>reader comment</p></section>
    <form>Mail <input></form><footer>c</footer></body></html>"""
    assert extract.main_text(page) == "Title & more\nFirst para with a link and text.\nSecond\nline\none\ntwo"
    assert extract.main_text("") == "" and extract.main_text("a &lt; b") == "a < b" and extract.main_text("<p>one<p>two") == "one\ntwo"
    assert extract.main_text("<body><nav>x</nav></body>") == ""


@pytest.mark.parametrize("wrapper", ["content-sidebar-wrap", "site has-sidebar", "menu-open", "with-comments"])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_names_around_the_article_do_not_drop_it(wrapper, inner):
    text = "A long sentence of the article that goes on for a while. " * 8
    page = f"<body><div class='{wrapper}'><{inner}><p>{text}</p><p title='the hidden cost of x' class='overflow hidden md'>{text}</p></{inner}></div></body>"
    assert extract.main_text(page) == "\n".join([text.strip()] * 2)


def test_reference_lists_of_an_article_stay():
    links = "".join(f"<li><a href=x>Reference number {i}</a>" for i in range(4))
    page = f"<body><ul>{links}</ul><article><p>{'Some words of text. ' * 20}</p><ul>{links}</ul></article><p hidden>gone</p></body>"
    assert extract.main_text(page).split("\n")[1:] == [f"Reference number {i}" for i in range(4)]


@pytest.mark.parametrize("name", ["comments", "comment-list", "reader-comments", "disqus thread"])
@pytest.mark.parametrize("inner", ["article", "div class=post"])
def test_reader_comments_go_however_long_they_are(name, inner):
    text, said = "A long sentence of the article that goes on for a while. " * 8, "<p>A reader says a good many things about all of this.</p>" * 60
    end = inner.split()[0]
    expected = text.strip()
    assert extract.main_text(f"<body><{inner}><p>{text}</p></{end}><div class='{name}'>{said}</div></body>") == expected
    assert extract.main_text(f"<body><{inner}><p>{text}</p><section id='{name}'>{said}</section></{end}></body>") == expected
    one = f"<article class=comment>{said}</article>"
    assert extract.main_text(f"<body><{inner}><p>{text}</p></{end}>{one}{one}</body>") == expected


def test_formulas_and_fallbacks_of_an_article_stay_and_cut_tags_go():
    page = "<body><article><p>Let <math><mi>x</mi></math> be.</p><noscript>Plain form.</noscript><p>End of it.</p><div cla"
    assert extract.main_text(page) == "Let x be.\nPlain form.\nEnd of it."
    assert extract.main_text("<p>It's <a href=x title=it's>one</a> of <b data-x='>'>two</b>, 1 <2 and a< b") == "It's one of two, 1 <2 and a< b"
    assert extract.main_text("<p>one</ x>two<!-->three<!-- a > b --!>four<!-- cut") == "onetwothreefour"


@pytest.mark.parametrize("page", [
    "<a '" * 100000, "<a x=\"y'" * 50000, "<span>" * 40000 + "</b>" * 40000, "<b><div>" + "<span>" * 40000 + "</b>" * 40000, "<" * 400000,
    "<!--" * 100000, "<!-" * 100000, "<p><ul><li>x" * 20000, "</" * 200000, "<script>" * 50000, "&" * 400000,
], ids=lambda p: p[:8])
def test_hostile_pages_take_time_in_proportion_to_their_length(page):
    began = time.monotonic()
    extract.main_text(page)
    assert time.monotonic() - began < 5


def test_page_table_cases(spark):
    rows = [(1, "u", "<p>one"), (1, "u", "<p>one"), (None, None, "<p>two"), (2, "v", None), (3, None, "")]
    pages = spark.createDataFrame([(*r, "clash", 7) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, extract.extract_pages(pages).collect()), key=str)
    assert got == sorted([(1, "u", "one", 3)] * 2 + [(None, None, "two", 3), (2, "v", "", 0), (3, None, "", 0)], key=str)
    assert extract.extract_pages(pages.limit(0)).count() == 0


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r, got in zip(pages.orderBy("page_id").collect(), extract.extract_pages(pages).orderBy("page_id").collect()):
        article = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S).group(1)
        parts = (" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split(r"<(?:/?(?:p|h1)|br)[^>]*>", article))
        assert got.text == "\n".join(p for p in parts if p)
        assert got.n_chars == len(got.text)
    assert extract.extract_pages(pages.select("page_id", "url", F.lit(None).alias("html"))).where("text <> ''").count() == 0


@pytest.mark.parametrize("operator", [
    exact.exact_duplicates, suffix.repeated_passages, jaccard.jaccard_components, ctw.context_tree_scores, mixing.mix_sources,
    mixing.mixed_texts, materialise.training_order,
], ids=lambda f: f.__name__)
def test_empty_tables(docs, operator):
    assert operator(docs.limit(0)).count() == 0


def test_unseen_words_keep_a_chance_whatever_the_counts(spark):
    # More words counted twice than once: the estimate of the first discount is negative.
    counts = spark.createDataFrame([(k, n) for n, many in ((1, 2), (2, 9), (3, 1), (4, 8)) for k in range(many)], "word int, n int")
    assert all(0 < d <= k + 1 for k, d in enumerate(kneser._discounts(counts)))


def test_mixed_texts_keep_their_lines(spark):
    """Cut texts are pieces of the text with its own blanks; the words taken are those of the plan."""
    rng = random.Random(11)
    rows = [(i, "".join(f"w{k}" + rng.choice([" ", "\n", "\t\t", " \n"]) for k in range(rng.randint(1, 90))), f"s{i % 4}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(docs, block_words=8).collect()}
    got, cut = collections.Counter(), 0
    for r in mixing.mixed_texts(docs, block_words=8).collect():
        whole = rows[r.doc_id][1]
        pieces = re.findall(r"\S+\s*", r.text)
        assert all(p.rstrip() in whole.split() for p in pieces) and r.text == r.text.lstrip()
        blanks = {w: b for b, w in re.findall(r"(\s*)(\S+)", whole)}
        assert all(b == blanks[w] for b, w in re.findall(r"(\s*)(\S+)", r.text)[1:])
        got[r.doc_id] += len(pieces)
        cut += r.text != whole
    assert {i: n for i, n in taken.items() if n} == dict(got) and cut > 5


def test_blocks_of_huge_sources_are_scattered(spark):
    """Numbers of blocks far beyond 32 bits neither overflow nor meet."""
    n, step = 10**11 + 7, 1327217909
    rows = spark.range(0, n, n // 500).select(F.col("id").alias("b"), F.lit(step).cast("bigint").alias("_step"))
    got = rows.select("b", mixing._scattered(F.col("b"), F.lit(n), 20).alias("at")).collect()
    assert [(r["b"] * step + 20) % n for r in got] == [r["at"] for r in got] and len({r["at"] for r in got}) == len(got)


def test_quality_model_is_fitted_on_every_trusted_row_of_one_half(spark):
    docs = spark.range(2600).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("word w"), "id").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    model, chosen = kneser.classifier(docs, labels)
    half = {r["doc_id"] for r in docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).collect()}
    assert len(half) > 1100 and {r["doc_id"] for r in chosen.collect()} == half
    # Each row adds a word of its own; "word" and the end are common.
    assert len(model.tables["word"][0]) == len(half) + 2
    assert kneser.classifier(docs, labels, 7)[1].count() == 7
