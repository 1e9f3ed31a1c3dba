"""N-gram Jaccard join as a blocked sparse product of documents by n-grams."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom.llm.blocks import (
    ASK_SCHEMA, NULL_ID, answered, ask_batch, mixed, pack, per_block, prefix_sums, read_block, replies_in_order,
    shard_count, shuffle_partitions, substring_hash, text_blocks, unpack, with_replies,
)
from diffloom.llm.components import components
from diffloom.session import checkpointed

BLOCK_DOCS = 1024  #: sets on a side of one product
BLOCK_GRAMS = 4_000_000  #: n-grams on a side of one product, about; long sets make smaller blocks
PIECE = 1 << 19


def _blank_table() -> np.ndarray:
    blank = np.zeros(256, bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    return blank


BLANK = _blank_table()


def shingle_sets(body: bytes, starts: np.ndarray, ends: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Each document's sorted distinct shingle hashes.

    Words are what stands between ASCII blanks, A-Z in lower case. With fewer than ``size``
    words the whole sequence is the one shingle; without words there is none.
    """
    lowered = np.frombuffer(body.lower(), np.uint8)
    at = 0
    while at < len(starts):
        till = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, "right")))
        base = starts[at]
        part = lowered[base : ends[till - 1]]
        blank = np.concatenate([[True], BLANK[part], [True]])
        # A document's first byte begins a word even behind the last word of another.
        begins = ~blank[1:-1] & blank[:-2]
        own = starts[at:till] - base
        own = own[own < len(part)]
        begins[own] = ~BLANK[part[own]]
        finishes = ~blank[1:-1] & blank[2:]
        last = ends[at:till] - base - 1
        last = last[last >= 0]
        finishes[last] = ~BLANK[part[last]]
        first, end = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        words = substring_hash(prefix_sums(part), first, end)
        lo = np.searchsorted(first, starts[at:till] - base)
        hi = np.searchsorted(first, ends[at:till] - base)
        factor = np.uint64(0x9FB21C651E98DF25)
        if len(words) >= size:
            grams = np.zeros(len(words) - size + 1, np.uint64)
            for k in range(size):
                grams = mixed(grams * factor + words[k : len(words) - size + 1 + k])
        for a, b in zip(lo.tolist(), hi.tolist()):
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            elif b > a:
                whole = np.zeros(1, np.uint64)
                for word in words[a:b]:
                    whole = mixed(whole * factor + word)
                yield mixed(whole + np.uint64(b - a))
            else:
                yield words[:0]
        at = till


def _fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """Two sums over a set; equal sets, and in 128 bits only those, have equal sums."""
    with np.errstate(over="ignore"):
        a = shingles.sum(dtype=np.uint64)
        b = mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _sets_of(row: dict, size: int):
    ids, lens, body = read_block(row)
    ends = np.cumsum(lens)
    sets = list(shingle_sets(body, ends - lens, ends, size))
    marks = [_fingerprint(s) for s in sets]
    # Equal sets of a block count once.
    first = {}
    for place, mark in enumerate(marks):
        first.setdefault((mark, len(sets[place])), place)
    distinct = np.concatenate([sets[p] for p in first.values()]) if first else np.zeros(0, np.uint64)
    grams, counts = np.unique(distinct, return_counts=True)
    return ids, sets, marks, grams, counts


def _sent_order(grams: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    shard = (grams % np.uint64(shards)).astype(np.int32)
    return shard, np.argsort(shard, kind="stable")


def _gram_request(row: dict, shards: int, size: int) -> pa.RecordBatch:
    _, _, _, grams, counts = _sets_of(row, size)
    shard, order = _sent_order(grams, shards)
    names, packed = [], []
    for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
        names.append(int(shard[part[0]]))
        rest = (grams[part] >> np.uint64(32)).astype(np.uint32)
        packed.append(np.int64(len(part)).tobytes() + rest.tobytes() + pack(np.minimum(counts[part], 2**31 - 1).astype(np.int32)))
    return ask_batch(row["block_id"], names, packed)


def _frequencies(asked: list[bytes]) -> list[bytes]:
    """Document frequency of each n-gram as a rank from 0 (in one set) to 255, in quarter octaves."""
    sizes = [int(np.frombuffer(a, np.int64, 1)[0]) for a in asked]
    rest = np.concatenate([np.frombuffer(a, np.uint32, n, 8) for a, n in zip(asked, sizes)])
    counts = np.concatenate([unpack(a[8 + 4 * n :], np.int32) for a, n in zip(asked, sizes)])
    _, place = np.unique(rest, return_inverse=True)
    total = np.bincount(place, weights=counts)
    rank = np.minimum(255, np.ceil(4 * np.log2(np.maximum(total, 1)))).astype(np.uint8)[place]
    return [pack(r) for r in np.split(rank, np.cumsum(sizes)[:-1])]


def _bound(size: int, percent: int) -> int:
    """The least overlap a set of this size can have with any set it links to."""
    return -(-percent * size // 100)


def _ordered(row: dict, shards: int, size: int, percent: int) -> pa.RecordBatch:
    """Each document's set size and fingerprint; for sets that can link to another, the n-grams, rarest first."""
    ids, sets, marks, grams, _ = _sets_of(row, size)
    _, lens, body = read_block(row)
    rank = np.zeros(len(grams), np.uint8)
    if len(grams):
        _, order = _sent_order(grams, shards)
        rank[order] = np.concatenate([unpack(r, np.uint8) for r in replies_in_order(row["ranks"])])
    ends = np.cumsum(lens)
    texts = [hashlib.md5(body[a:b]).hexdigest() for a, b in zip((ends - lens).tolist(), ends.tolist())]
    kept = []
    for shingles in sets:
        own = rank[np.searchsorted(grams, shingles)]
        shared = int((own > 0).sum())
        if len(shingles) and shared >= _bound(len(shingles), percent):
            order = np.lexsort((shingles, own))
            kept.append(np.int64(len(shingles) - shared).tobytes() + shingles[order].tobytes())
        else:
            kept.append(None)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([None if i == NULL_ID else int(i) for i in ids], pa.int64()),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()),
            pa.array(texts), pa.array(kept, pa.binary()),
        ],
        names=["doc_id", "n_shingles", "mark_a", "mark_b", "text_md5", "grams"],
    )


SETS_SCHEMA = "doc_id bigint, n_shingles bigint, mark_a bigint, mark_b bigint, text_md5 string, grams binary"


def _postings(percent: int):
    """The n-grams that a linked pair must share one of: the rarest, as many as the size bound leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                alone = int(np.frombuffer(data, np.int64, 1)[0])
                grams = np.frombuffer(data, np.int64, offset=8)
                prefix = grams[alone : len(grams) - _bound(len(grams), percent) + 1]
                if len(prefix):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(prefix), pa.array(np.full(len(prefix), node, np.int64))], names=["gram", "node"])

    return run


def _product(sets: list[np.ndarray], side: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each set with the later ones it links to, by places: inside the one block if ``side`` has one value, else across two blocks.

    Overlaps of one row with all columns are accumulated from the postings of its n-grams.
    """
    sizes = np.array([len(s) for s in sets])
    column = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(column, kind="stable")
    grams, first = np.unique(column[order], return_index=True)
    bounds = np.append(first, len(column))
    owner = owner[order]
    one = len(np.unique(side)) == 1
    for x in range(len(sets)) if one else np.flatnonzero(side == side.min()):
        at = np.searchsorted(grams, sets[x])
        many = at[bounds[at + 1] - bounds[at] > 1]
        if not len(many):
            continue
        n = bounds[many + 1] - bounds[many]
        places = np.repeat(bounds[many] - np.cumsum(n) + n, n) + np.arange(n.sum())
        overlap = np.bincount(owner[places], minlength=len(sets))
        near = (100 * sizes >= percent * sizes[x]) & (100 * sizes[x] >= percent * sizes)
        met = np.flatnonzero(near & (100 * overlap >= percent * (sizes + sizes[x] - overlap)))
        met = met[met > x] if one else met[side[met] != side[x]]
        if len(met):
            yield int(x), met


def _products(percent: int, made: Callable[[pd.DataFrame, Iterator[tuple[int, np.ndarray]]], pd.DataFrame], empty: pd.DataFrame):
    """``made`` of every block product in a task."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = [empty]
        for (_, i, j), rows in group.groupby(["cluster", "i", "j"], sort=False):
            side = rows["own"].to_numpy()
            if i == j or len(np.unique(side)) > 1:
                out.append(made(rows, _product([np.frombuffer(g, np.uint64, offset=8) for g in rows["grams"]], side, percent)))
        return pd.concat(out)

    return run


def _pairs_of(rows: pd.DataFrame, links: Iterator[tuple[int, np.ndarray]]) -> pd.DataFrame:
    node = rows["node"].to_numpy()
    found = [(np.full(len(met), node[x]), node[met]) for x, met in links]
    a, b = (np.concatenate(c) if c else node[:0] for c in (list(zip(*found)) or ((), ())))
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _sums_of(rows: pd.DataFrame, links: Iterator[tuple[int, np.ndarray]]) -> pd.DataFrame:
    """For each set with a link in this product: the rows of the sets it links to, and the least place it is connected to."""
    node, n_rows = rows["node"].to_numpy(), rows["n_rows"].to_numpy()
    met_rows, tree = np.zeros(len(rows), np.int64), np.arange(len(rows))
    for x, met in links:
        met_rows[x] += n_rows[met].sum()
        met_rows[met] += n_rows[x]
        trees = np.unique(tree[np.append(met, x)])
        if len(trees) > 1:  # happens once less than there are sets
            tree[np.isin(tree, trees)] = trees[0]
    linked = met_rows > 0
    return pd.DataFrame({"node": node[linked], "met": met_rows[linked], "root": node[tree[linked]]})


def _dealt(rows: DataFrame, block_docs: int) -> DataFrame:
    """Every pair of blocks of a cluster, in one task; small clusters share a task."""
    grams = F.octet_length("grams") / 8
    sizes = rows.groupBy("cluster").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / block_docs), F.ceil(F.sum(grams) / BLOCK_GRAMS)).cast("int").alias("_blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    dealt = rows.join(sizes, "cluster").withColumn("_own", block)
    return dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        "cluster", "node", "n_rows", "grams", F.col("_own").alias("own"),
        F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"),
        F.when(F.col("_blocks") > 1, F.xxhash64("cluster", F.least("_own", "_other"), F.greatest("_own", "_other")))
        .otherwise(F.pmod(F.xxhash64("cluster"), F.lit(max(64, 4 * shuffle_partitions(rows))))).alias("_task"))


def jaccard_components(docs: DataFrame, shingle_words: int = 5, percent: int = 80, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``jaccard_links`` without the numbers of links."""
    return jaccard_links(docs, shingle_words, percent, block_docs).select("doc_id", "n_shingles", "component_id")


def jaccard_pairs(docs: DataFrame, shingle_words: int = 5, percent: int = 80, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Every linked pair of distinct sets once, ``doc_a`` and ``doc_b`` being the least doc_id of each set's rows.

    As many rows as there are pairs; the other functions here need only sums of them, which the products add up themselves.
    """
    _, classes, grouped = _matrix(docs, shingle_words, percent)
    none = pd.DataFrame({"a": [], "b": []}, dtype="int64")
    pairs = _dealt(grouped, block_docs).groupBy("_task").applyInPandas(_products(percent, _pairs_of, none), "a bigint, b bigint")
    names = classes.select("class", "node")
    named = pairs.join(names.toDF("a", "_a"), "a").join(names.toDF("b", "_b"), "b")
    return named.select(_nulled(F.least("_a", "_b")).alias("doc_a"), _nulled(F.greatest("_a", "_b")).alias("doc_b"))


def jaccard_links(docs: DataFrame, shingle_words: int = 5, percent: int = 80, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``n_links``, the number of other rows it links to, of every row.

    Two rows link when ``100 * intersection >= percent * union`` of their distinct shingle
    sets; ``component_id`` is the least doc_id reachable by links, its own included. The matrix of
    sets by n-grams is cut three times by bounds that follow from a set's size n and lose no
    link. (1) A set that shares fewer than ``percent * n`` of its n-grams with any other has no
    link but to equal sets. (2) Rarest first, linked sets share one of the first
    ``n - bound + 1`` n-grams; sets that share none, even through others, fall into
    different clusters. (3) In a cluster, blocks of rows are multiplied by blocks of rows: overlaps
    accumulate over the postings of a row, and pairs below the bound of the two sizes are discarded.
    Equal sets are one row of the matrix; a cluster of any size is dealt out as pairs of blocks. A product returns, for
    each of its rows, the number of rows it links to and a tree of its links, never the pairs.

    Words are compared by 64-bit hashes, sets by 128-bit sums. Rows without words have no
    shingles and their own component; a null doc_id is smaller than any number; repeated rows fall
    into one component and link to each other; an empty table gives no rows.
    """
    found = _rows(docs, shingle_words, percent, block_docs)
    return found.select(_nulled(F.col("doc_id")).alias("doc_id"), "n_shingles", _nulled(F.col("component_id")).alias("component_id"), "n_links")


def _rows(docs: DataFrame, shingle_words: int, percent: int, block_docs: int) -> DataFrame:
    """Every row with its text's MD5, the class that names its component (null without words), least doc_id and number of links."""
    sets, classes, grouped = _matrix(docs, shingle_words, percent)
    none = pd.DataFrame({"node": [], "met": [], "root": []}, dtype="int64")
    # Linear in rows and blocks: a group of n near copies makes n rows for each block that it meets, not its pairs.
    sums = checkpointed(_dealt(grouped, block_docs).groupBy("_task").applyInPandas(
        _products(percent, _sums_of, none), "node bigint, met bigint, root bigint"))
    linked = components(sums.select(F.col("node").alias("a"), F.col("root").alias("b")))
    met = sums.groupBy(F.col("node").alias("class")).agg(F.sum("met").alias("_met"))
    of_class = classes.join(linked.withColumnRenamed("node", "class"), "class", "left").join(met, "class", "left").select(
        "class", "node", F.coalesce("component", "class").alias("component"),
        (F.col("n_rows") - 1 + F.coalesce("_met", F.lit(0))).alias("n_links"))
    least = of_class.groupBy("component").agg(F.min("node").alias("component_id"))
    by_class = of_class.join(least, "component").select("class", "component", "component_id", "n_links")
    own = sets.withColumn("class", F.when(F.col("n_shingles") > 0, F.xxhash64("n_shingles", "mark_a", "mark_b")))
    return own.join(by_class, "class", "left").select(
        "doc_id", "text_md5", "n_shingles", "component", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _matrix(docs: DataFrame, shingle_words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their set's marks, classes of equal sets with their least doc_id, and the matrix: a class, its cluster and n-grams."""
    blocks = text_blocks(docs)
    shards = shard_count(blocks, 0.75)
    asked = per_block(blocks, lambda row: _gram_request(row, shards, shingle_words), ASK_SCHEMA)
    ranked = with_replies(blocks, answered(asked, _frequencies), "ranks")
    table = checkpointed(per_block(ranked, lambda row: _ordered(row, shards, shingle_words, percent), SETS_SCHEMA))

    filled = F.coalesce("doc_id", F.lit(NULL_ID))
    keys = ["n_shingles", "mark_a", "mark_b"]
    sets = table.select(filled.alias("doc_id"), "text_md5", *keys)
    classes = sets.where("n_shingles > 0").groupBy(*keys).agg(
        F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n_rows"))
    # One row of the matrix for each class; its n-grams come from any of its documents.
    # Nodes are numbered by class, so that rows which share a doc_id stay apart.
    rows = table.where("grams is not null").groupBy(*keys).agg(F.min("grams").alias("grams"), F.count(F.lit(1)).alias("n_rows"))
    rows = checkpointed(rows.select(F.xxhash64(*keys).alias("node"), "n_rows", "grams"))
    postings = checkpointed(rows.select("node", "grams").mapInArrow(_postings(percent), "gram bigint, node bigint"))
    leaders = postings.groupBy("gram").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    clusters = components(postings.join(leaders, "gram").select("a", F.col("node").alias("b")).distinct())
    grouped = rows.join(clusters, "node").select("node", F.col("component").alias("cluster"), "n_rows", "grams")
    return sets, classes.select(F.xxhash64(*keys).alias("class"), "node", "n_rows"), grouped


def _nulled(column: Column) -> Column:
    return F.when(column != NULL_ID, column)


def without_copies(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the first by doc_id, then by the MD5 of its text, stays.

    Rows are told apart by doc_id and text, so texts that share a doc_id, or have none, are judged one by one; a missing
    doc_id comes after all others. Rows alike in both are one. Rows without words link with nothing and stay.
    """
    found = _rows(docs.select("doc_id", "text"), shingle_words, percent, BLOCK_DOCS)
    order = F.struct((F.col("doc_id") == NULL_ID).alias("nameless"), "doc_id", "text_md5")
    first = found.where("component is not null").groupBy("component").agg(F.min(order).alias("w")).select("w.doc_id", "w.text_md5")
    alone = found.where("component is null").select("doc_id", "text_md5").distinct()
    stays = first.unionByName(alone).toDF("_id", "_md5")
    keyed = docs.withColumns({"_key": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)), "_text": F.md5(F.coalesce("text", F.lit("")))})
    kept = keyed.join(stays, (F.col("_key") == F.col("_id")) & (F.col("_text") == F.col("_md5")), "left_semi")
    return kept.dropDuplicates(["_key", "_text"]).drop("_key", "_text")
