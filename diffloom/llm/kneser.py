"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom.llm.blocks import (
    mixed, pack, pack_sorted, packed_blocks, per_block, prefix_sums, read_block, shuffle_partitions, substring_hash, unpack,
    unpack_sorted,
)
from diffloom.llm.words import sent_to_tasks
from diffloom.session import checkpointed, dropped, stored

MODEL_ROWS = 4_000_000  #: most rows of a model that is sent to tasks; a larger one is joined in shards
SHARD_ROWS = 1_000_000
QUANTILE = 0.995
LEAST_TRUSTED = 50  #: a language with fewer trusted rows takes the threshold of all languages together
PIECE = 1 << 19
FIT_LOTS, FIT_LOT_BYTES = 4, 4 << 20  #: n-grams of a large model are counted in so many lots at most, of so much text at least
SCORE_LOTS, SCORE_LOT_BYTES = 10, 16 << 20  #: rows meet a large model in so many lots at most, of so much text at least

BEGIN, END = np.uint64(1), np.uint64(2)

#: Tables of a model in tasks: chances of words, pairs and triples, and what the contexts of pairs and triples leave to the order below.
KEY_KINDS = ("word", "pair", "triple", "before1", "before2")


def _classes() -> np.ndarray:
    """0 for blanks, 1 for letters, digits and all bytes of other scripts, 2 for signs."""
    kinds = np.full(256, 2, np.uint8)
    kinds[[0x20, *range(0x09, 0x0E)]] = 0
    kinds[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
    return kinds


KINDS = _classes()


def _token_rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text between two begins and an end, and each text's number of tokens with its end.

    Tokens are runs of letters and digits, and runs of signs, with A-Z in lower case.
    """
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    stop = np.cumsum([len(t) + 1 for t in texts])
    kind = KINDS[data]
    change = np.flatnonzero(np.diff(kind, prepend=0) != 0)
    first = change[kind[change] > 0]
    last = np.append(change, len(data))[np.searchsorted(change, first, "right")]
    words = substring_hash(prefix_sums(data), first, last)
    counts = np.diff(np.searchsorted(first, stop), prepend=0)
    out = np.full(len(words) + 3 * len(texts), BEGIN)
    doc = np.repeat(np.arange(len(texts)), counts)
    out[np.arange(len(words)) + 3 * doc + 2] = words
    out[np.cumsum(counts + 3) - 1] = END
    return out, counts + 1


def _pair_keys(before1: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(before1 * np.uint64(0x9FB21C651E98DF25) + word)


def _triple_keys(before2: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(before2 * np.uint64(0xC2B2AE3D27D4EB4F) + word + np.uint64(1))


BEGIN_PAIR = _pair_keys(np.array([BEGIN]), np.array([BEGIN]))[0]


def _keys(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pairs and triples that end at each token (garbage at the first one or two)."""
    pairs = tokens.copy()
    pairs[1:] = _pair_keys(tokens[:-1], tokens[1:])
    triples = pairs.copy()
    triples[1:] = _triple_keys(pairs[:-1], tokens[1:])
    return pairs, triples


def _scored(counts: np.ndarray) -> np.ndarray:
    """Places of the tokens that are predicted: all but the two begins of each text."""
    places = np.ones(int((counts + 2).sum()), bool)
    start = np.cumsum(counts + 2) - (counts + 2)
    places[start] = places[start + 1] = False
    return np.flatnonzero(places)


def _groups(texts: list) -> Iterator[tuple[int, list[bytes]]]:
    at, held, size = 0, [], 0
    for k, text in enumerate(texts):
        held.append(text or b"")
        size += len(held[-1])
        if size >= PIECE:
            yield at, held
            at, held, size = k + 1, [], 0
    if held:
        yield at, held


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in _groups(batch.column(0).cast(pa.binary()).to_pylist()):
            tokens, counts = _token_rows(texts)
            pairs, triples = _keys(tokens)
            at = _scored(counts)
            columns = [triples[at], pairs[at], pairs[at - 1], tokens[at], tokens[at - 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.view(np.int64)) for c in columns], names=["triple", "pair", "before2", "word", "before1"])


def _discount(n: Column, d: list[float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def _discounts(counts: DataFrame) -> list[float]:
    """The three discounts from how many n-grams were counted once to four times."""
    seen = {r["n"]: r["m"] for r in counts.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect()}
    return _estimated([float(seen.get(k, 0)) for k in range(1, 5)])


def _estimated(n: list[float]) -> list[float]:
    usual = [0.5, 1.0, 1.5]
    if not all(n[:3]):
        return usual
    y = n[0] / (n[0] + 2 * n[1])
    found = [(k + 1) - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
    # Without a discount nothing would be left for unseen words: their chance would be 0, the perplexity infinite.
    return [d if 0 < d <= k + 1 else usual[k] for k, d in enumerate(found)]


def _level(counts: DataFrame, context: str, lower: DataFrame | None, key: str, lower_key: str, floor: float = 0.0):
    """Interpolated probabilities of one order and the weight that each context leaves to the order below.

    Counts meet their context's totals and the lower order's probabilities by joins on keys.
    """
    d = _discounts(counts)
    totals = counts.groupBy(context).agg(
        F.sum("n").alias("total"), F.sum(_discount(F.col("n"), d)).alias("left")).withColumn("weight", F.col("left") / F.col("total"))
    own = (F.col("n") - _discount(F.col("n"), d)) / F.col("total")
    joined = counts.join(totals, context)
    if lower is None:
        chance = own + F.col("weight") * floor
    else:
        joined = joined.join(lower.select(F.col("key").alias(lower_key), F.col("chance").alias("below")), lower_key)
        chance = own + F.col("weight") * F.col("below")
    return (joined.select(F.col(key).alias("key"), chance.alias("chance")),
            totals.select(F.col(context).alias("key"), F.col("weight").alias("chance")))


class Model:
    """Sorted key tables of the three orders and the contexts' weights; small enough for every task."""

    def __init__(self, tables: dict[str, tuple[np.ndarray, np.ndarray]], unknown: float):
        self.tables, self.unknown = tables, unknown

    def look_up(self, name: str, keys: np.ndarray, missing: np.ndarray | float) -> np.ndarray:
        known, values = self.tables[name]
        if not len(known):
            return np.broadcast_to(missing, keys.shape).astype(np.float64)
        # Sorted questions walk through the table in order.
        distinct, place = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
        found = (known[at] == distinct)[place]
        return np.where(found, values[at][place], missing)

    def log_chances(self, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
        pairs, triples = _keys(tokens)
        at = _scored(counts)
        one = self.look_up("word", tokens[at], self.unknown)
        two = self.look_up("pair", pairs[at], self.look_up("before1", tokens[at - 1], 1.0) * one)
        three = self.look_up("triple", triples[at], self.look_up("before2", pairs[at - 1], 1.0) * two)
        return np.log(three)


@dataclass
class ShardedModel:
    """Counts of a model of any size in stored, packed key shards; chances are worked out where texts are scored.

    A triple is kept with its count in the shard of the pair that it ends with. A pair is kept with the number of its distinct
    triples, and, as a context, with the total of what follows it and how much of that was counted once, twice and more often.
    Words are kept likewise, with numbers of distinct pairs.
    """

    paths: list[str]
    shards: int
    rows: int
    discounts: list[list[float]]  # of words, pairs and triples
    distinct_pairs: int
    left: float  # what the words leave to unseen words
    floor: float

    @property
    def unknown(self) -> float:
        return self.left * self.floor


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def _dealt(shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each shard and where it stands in an ascending list of shards."""
    used, first = np.unique(shard, return_index=True)
    for number, start, stop in zip(used.tolist(), first.tolist(), [*first.tolist()[1:], len(shard)]):
        yield number, slice(start, stop)


def _unique(keys: np.ndarray) -> np.ndarray:
    """Distinct keys in order; sorting is several times faster than ``np.unique`` for plain numbers."""
    ordered = np.sort(keys)
    return ordered[np.diff(ordered, prepend=~ordered[:1]) != 0]


def _places(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where each asked key stands among the sorted ``keys``, which hold it; sorted questions walk through them in order."""
    order = np.argsort(asked)
    out = np.empty(len(asked), np.int64)
    out[order] = np.searchsorted(keys, asked[order])
    return out


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counts in the narrowest whole numbers that hold them all."""
    kind = np.min_scalar_type(-int(counts.max(initial=1)) - 1)
    return kind.char.encode() + pack(counts.astype(kind))


def _unpack_counts(data: bytes, planes: int = 1) -> np.ndarray:
    return unpack(data[1:], np.dtype(data[:1].decode())).reshape(planes, -1)


def _joined(parts: list[np.ndarray], kind=np.uint64) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *parts])


def _block_grams(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Word, word before, pair, pair before and triple of each predicted token of a block, and each text's number of them."""
    _, lens, body = read_block(row)
    ends = np.cumsum(lens)
    grams, sizes = [], []
    for _, texts in _groups([body[end - size : end] for size, end in zip(lens, ends)]):
        tokens, counts = _token_rows(texts)
        pairs, triples = _keys(tokens)
        at = _scored(counts)
        grams.append(np.stack([tokens[at], tokens[at - 1], pairs[at], pairs[at - 1], triples[at]]))
        sizes.append(counts)
    return np.concatenate(grams, axis=1), np.concatenate(sizes)


# Counting: every distinct triple goes to the shard of the pair that it ends with, and to the shard of the pair that it starts with.

COUNT_SCHEMA = "shard int, context boolean, before2 binary, before1 binary, word binary, n binary"
TABLE_SCHEMA = ("shard int, pairs binary, pair_facts binary, triples binary, counts binary, words binary, word_facts binary, "
                "seen array<bigint>")
FACTS = 5  #: continuations; total, and followers counted once, twice, more often


def _followed(contexts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each context's total, and how many of its followers were counted once, twice and more often."""
    keys, place = np.unique(contexts, return_inverse=True)
    sums = [counts, counts == 1, counts == 2, counts > 2]
    return keys, np.stack([np.bincount(place, x, minlength=len(keys)).astype(np.int64) for x in sums])


def _facts(ends: np.ndarray, continued: np.ndarray, contexts: np.ndarray, followed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = _unique(np.concatenate([ends, contexts]))
    facts = np.zeros((FACTS, len(keys)), np.int64)
    facts[0, np.searchsorted(keys, ends)] = continued
    facts[1:, np.searchsorted(keys, contexts)] = followed
    return keys, facts


def _histogram(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in range(1, 5)]


def _counted(group: pd.DataFrame) -> pd.DataFrame:
    """The tables of one shard: its pairs, the triples that end with them, and what these add to words."""
    found = []
    for context in (False, True):
        some = group[group["context"] == context]
        before2, before1, word = (_joined([unpack(d, np.uint64) for d in some[c]]) for c in ("before2", "before1", "word"))
        n = _joined([unpack(d, np.int64) for d in some["n"]], np.int64)
        keys, first, place = np.unique(_triple_keys(before2, word), return_index=True, return_inverse=True)
        counts = np.bincount(place, n, minlength=len(keys)).astype(np.int64)
        found.append((keys, counts, before2[first], before1 if context else before1[first], word[first]))
    triples, counts, _, before1, word = found[0]
    ends, at, continued = np.unique(_pair_keys(before1, word), return_index=True, return_counts=True)
    pairs, facts = _facts(ends, continued, *_followed(found[1][2], found[1][1]))
    words, word_facts = _facts(*np.unique(word[at], return_counts=True), *_followed(before1[at], continued))
    return pd.DataFrame({
        "shard": [group["shard"].iloc[0]], "pairs": [pack_sorted(pairs)], "pair_facts": [_pack_counts(facts)], "triples": [pack_sorted(triples)],
        "counts": [_pack_counts(counts)], "words": [pack_sorted(words)], "word_facts": [pack(word_facts)],
        "seen": [[*_histogram(counts), *_histogram(continued), len(triples), len(ends)]]})


def _counted_triples(blocks: DataFrame, shards: int, lots: int, lot: int) -> DataFrame:
    def send(row: dict) -> pa.RecordBatch:
        (word, before1, pair, before2, triple), _ = _block_grams(row)
        _, first, n = np.unique(triple, return_index=True, return_counts=True)
        columns: list[list] = [[] for _ in range(6)]
        for context, owner in ((False, pair[first]), (True, before2[first])):
            mine = np.flatnonzero((owner >> np.uint64(8)) % np.uint64(lots) == np.uint64(lot))
            mine = mine[np.argsort(owner[mine])]
            shard = _shard_of(owner[mine], shards)
            order = np.argsort(shard, kind="stable")
            mine, at = mine[order], first[mine[order]]
            for number, some in _dealt(shard[order]):
                # A context's count needs no word before.
                parts = [before2[at[some]], at[:0].astype(np.uint64) if context else before1[at[some]], word[at[some]], n[mine[some]].astype(np.int64)]
                for column, value in zip(columns, [number, context, *map(pack, parts)]):
                    column.append(value)
        kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["shard", "context", "before2", "before1", "word", "n"])

    return per_block(blocks, send, COUNT_SCHEMA).groupBy("shard").applyInPandas(_counted, TABLE_SCHEMA)


def _counted_words(tables: DataFrame, shards: int) -> DataFrame:
    """Facts about words, added up over the shards of pairs and dealt to the words' own shards."""
    parts = -(-shards // 8)

    def send(row: dict) -> pa.RecordBatch:
        words, facts = unpack_sorted(row["words"]), unpack(row["word_facts"], np.int64).reshape(FACTS, -1)
        part = _shard_of(words, shards) % parts
        order = np.argsort(part, kind="stable")
        rows = [(number, pack_sorted(words[order[some]]), pack(facts[:, order[some]])) for number, some in _dealt(part[order])]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["part", "words", "word_facts"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        words, place = np.unique(_joined([unpack_sorted(d) for d in group["words"]]), return_inverse=True)
        sent = np.concatenate([unpack(d, np.int64).reshape(FACTS, -1) for d in group["word_facts"]], axis=1)
        facts = np.stack([np.bincount(place, x, minlength=len(words)).astype(np.int64) for x in sent])
        shard = _shard_of(words, shards)
        order = np.argsort(shard, kind="stable")
        rows = []
        for number, some in _dealt(shard[order]):
            own = facts[:, order[some]]
            seen = [*_histogram(own[0]), int((own[0] > 0).sum()), int(own[0].sum())]
            rows.append((number, pack_sorted(words[order[some]]), _pack_counts(own), seen))
        return pd.DataFrame(rows, columns=["shard", "words", "word_facts", "seen"])

    sent = per_block(tables.select("words", "word_facts"), send, "part int, words binary, word_facts binary")
    return sent.groupBy("part").applyInPandas(add, "shard int, words binary, word_facts binary, seen array<bigint>")


def _summed(tables: DataFrame, size: int) -> list[int]:
    return [int(x or 0) for x in tables.agg(*[F.sum(F.get("seen", F.lit(k))) for k in range(size)]).first()]


def _sharded_model(blocks: DataFrame, tokens: int) -> ShardedModel:
    """Counts every n-gram of the blocks, lot by lot: a lot's messages leave the disk when its tables are written."""
    spark = blocks.sparkSession
    shards = max(shuffle_partitions(blocks), -(-tokens // SHARD_ROWS))
    lots = _lots(blocks.agg(F.sum(F.octet_length("body"))).first()[0] or 0, FIT_LOT_BYTES // 3, FIT_LOTS)
    made = [stored(_counted_triples(blocks, shards, lots, lot), "ngrams") for lot in range(lots)]
    tables = spark.read.parquet(*made)
    *seen, triples, pairs = _summed(tables, 10)
    words = stored(_counted_words(tables, shards), "words")
    *known, size, distinct = _summed(spark.read.parquet(words), 6)
    discounts = [_estimated([float(n) for n in some]) for some in (known, seen[4:], seen[:4])]
    once, twice = known[:2]
    left = sum(d * n for d, n in zip(discounts[0], (once, twice, size - once - twice))) / max(distinct, 1) if size else 1.0
    # What shards of pairs added to words is in the words' table now.
    kept = stored(tables.select("shard", "pairs", "pair_facts", "triples", "counts"), "ngrams")
    dropped(spark, *made)
    return ShardedModel([kept, words], shards, triples + pairs + size, discounts, distinct, left, 1.0 / (size + 1))


def _lots(size: int, least: int, most: int) -> int:
    return min(most, max(1, size // least))


# Scoring: blocks of texts ask each shard once for the facts about their distinct words, pairs and triples.

ASKED = ("words", "pairs", "triples")
ASKED_SCHEMA = "shard int, block_id bigint, words binary, pairs binary, triples binary"


def _distinct(grams: np.ndarray, shards: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words, pairs and triples: the distinct keys, their shards, and the order of the keys by shard."""
    word, _, pair, _, triple = grams
    # What stands before a token is the token before, or the begin of a text.
    words, pairs = _unique(np.append(word, BEGIN)), _unique(np.append(pair, BEGIN_PAIR))
    order = np.argsort(triple)
    ordered = triple[order]
    first = np.flatnonzero(np.diff(ordered, prepend=~ordered[:1]))
    found = []
    for keys, owner in ((words, words), (pairs, pairs), (ordered[first], pair[order[first]])):
        shard = _shard_of(owner, shards)
        found.append((keys, shard, np.argsort(shard, kind="stable")))
    return found


def _asked(row: dict, shards: int) -> pa.RecordBatch:
    parts: dict[int, list[bytes]] = {}
    none = pack_sorted(np.empty(0, np.uint64))
    for k, (keys, shard, order) in enumerate(_distinct(_block_grams(row)[0], shards)):
        for number, some in _dealt(shard[order]):
            parts.setdefault(number, [none] * 3)[k] = pack_sorted(keys[order[some]])
    return pa.RecordBatch.from_arrays(
        [pa.array(list(parts), pa.int32()), pa.array([row["block_id"]] * len(parts), pa.int64()),
         *[pa.array([p[k] for p in parts.values()], pa.binary()) for k in range(3)]], names=["shard", "block_id", *ASKED])


def _answered(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    out = {"shard": asked["shard"], "block_id": asked["block_id"]}
    for kind, values, planes in (("words", "word_facts", FACTS), ("pairs", "pair_facts", FACTS), ("triples", "counts", 1)):
        own = known[known[kind].notna()]
        keys = _joined([unpack_sorted(d) for d in own[kind]])
        facts = np.concatenate([np.empty((planes, 0), np.int8), *[_unpack_counts(d, planes) for d in own[values]]], axis=1)
        order = np.argsort(keys)
        keys = keys[order]
        replies = []
        for data in asked[kind]:
            wanted = unpack_sorted(data)
            reply = np.zeros((planes, len(wanted)), facts.dtype)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == wanted)
                reply[:, hit] = facts[:, order[at[hit]]]
            replies.append(_pack_counts(reply))
        out[kind] = replies
    return pd.DataFrame(out)


def _discounted(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return np.where(counts > 0, counts - np.array(d)[np.clip(counts, 1, 3) - 1], 0.0)


def _shares(contexts: np.ndarray, d: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """What a count is worth in each context, and what the context leaves to the order below: all, if it was never seen."""
    total = contexts[1]
    most = np.maximum(total, 1)
    return (total > 0) / most, np.where(total > 0, (d @ contexts[2:]) / most, 1.0)


def _block_scores(row: dict, model: ShardedModel) -> pa.RecordBatch:
    ids, _, _ = read_block(row)
    grams, n = _block_grams(row)
    replies = sorted(row["replies"], key=lambda r: r["shard"])
    facts = []
    for kind, planes, (keys, _, order) in zip(ASKED, (FACTS, FACTS, 1), _distinct(grams, model.shards)):
        values = np.empty((planes, len(keys)), np.int64)
        values[:, order] = np.concatenate([_unpack_counts(r[kind], planes) for r in replies], axis=1)
        facts.append((keys, values))
    (words, of_words), (pairs, of_pairs), (triples, of_triples) = facts
    word, _, pair, _, triple = grams
    d1, d2, d3 = model.discounts
    first = np.cumsum(n) - n

    def before(places: np.ndarray, begin: int) -> np.ndarray:
        out = np.roll(places, 1)
        out[first] = begin
        return out

    at_word, at_pair = _places(words, word), _places(pairs, pair)
    one = (_discounted(of_words[0], d1) / max(model.distinct_pairs, 1) + model.unknown)[at_word]
    worth, weight = _shares(of_words, d2)
    at = before(at_word, np.searchsorted(words, BEGIN))
    two = _discounted(of_pairs[0], d2)[at_pair] * worth[at] + weight[at] * one
    worth, weight = _shares(of_pairs, d3)
    at = before(at_pair, np.searchsorted(pairs, BEGIN_PAIR))
    three = _discounted(of_triples[0], d3)[_places(triples, triple)] * worth[at] + weight[at] * two
    totals = np.add.reduceat(np.log(three), first)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.array(n, pa.int64()), pa.array(np.exp(-totals / n))], names=["_place", "n_tokens", "perplexity"])


def _sharded_perplexities(docs: DataFrame, model: ShardedModel, keep: list[str]) -> DataFrame:
    """``perplexities`` in lots of rows: what a lot asks and hears leaves the disk when its scores are written."""
    spark = docs.sparkSession
    table = spark.read.parquet(model.paths[0]).unionByName(spark.read.parquet(model.paths[1]).drop("seen"), allowMissingColumns=True)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lots = _lots(size, SCORE_LOT_BYTES, SCORE_LOTS)
    lot_of = F.pmod(F.xxhash64(*[c for c in ("doc_id", "text") if c in docs.columns]), F.lit(lots))
    made = []
    for lot in range(lots):
        own = docs.where(lot_of == lot).select("text", *[c for c in keep if c != "text"]).withColumn("_place", F.monotonically_increasing_id())
        paths = [stored(own, "lot")]
        rows = spark.read.parquet(paths[0])
        paths.append(stored(packed_blocks(rows.select(F.col("_place").alias("doc_id"), "text")), "blocks"))
        blocks = spark.read.parquet(paths[1])
        asked = per_block(blocks, lambda row: _asked(row, model.shards), ASKED_SCHEMA)
        replies = asked.groupBy("shard").cogroup(table.groupBy("shard")).applyInPandas(_answered, ASKED_SCHEMA)
        listed = replies.groupBy("block_id").agg(F.collect_list(F.struct("shard", *ASKED)).alias("replies"))
        scores = per_block(blocks.join(listed, "block_id"), lambda row: _block_scores(row, model), "_place bigint, n_tokens bigint, perplexity double")
        made.append(stored(rows.join(scores, "_place").select(*keep, "n_tokens", "perplexity"), "scores"))
        dropped(spark, *paths)
    return spark.read.parquet(*made)


def _gathered(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A bounded table as sorted arrays; tasks send twelve packed bytes for each row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column(0).to_numpy().tobytes()], pa.binary()),
                 pa.array([batch.column(1).to_numpy().astype(np.float32).tobytes()], pa.binary())], names=["k", "v"])

    rows = table.select(F.col("key").cast("bigint"), F.col("chance").cast("double")).mapInArrow(pack, "k binary, v binary").collect()
    keys = np.frombuffer(b"".join(r["k"] for r in rows), np.uint64)
    values = np.frombuffer(b"".join(r["v"] for r in rows), np.float32)
    order = np.argsort(keys)
    return keys[order], values[order]


def train(texts: DataFrame, model_rows: int = MODEL_ROWS) -> Model | ShardedModel:
    """A model of the ``text`` column by counts of n-grams and continuations, discounts and interpolation.

    Up to ``model_rows`` n-grams its tables are joined and sent to tasks; of a larger one the counts are kept in packed shards.
    """
    spark = texts.sparkSession
    path = stored(packed_blocks(texts.select(F.lit(0).alias("doc_id"), "text")), "fitted")
    blocks = spark.read.parquet(path)
    count = lambda row: pa.RecordBatch.from_arrays([pa.array([int(_block_grams(row)[1].sum())])], names=["n"])
    tokens = per_block(blocks, count, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # There are at most three n-grams for each token.
    model = _joined_model(texts) if 3 * tokens <= model_rows else _sharded_model(blocks, tokens)
    dropped(spark, path)
    return model


def _joined_model(texts: DataFrame) -> Model:
    """A bounded model by count joins."""
    grams = checkpointed(
        texts.select("text").mapInArrow(_grams, "triple bigint, pair bigint, before2 bigint, word bigint, before1 bigint")
        .groupBy("triple", "pair", "before2", "word", "before1").agg(F.count(F.lit(1)).alias("n")))
    pairs = checkpointed(grams.groupBy("pair", "word", "before1").agg(F.count(F.lit(1)).alias("n")))
    words = checkpointed(pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0)))
    size = words.count()
    floor = 1.0 / (size + 1)
    p1, w1 = _level(words, "all", None, "word", "", floor)
    p2, w2 = _level(pairs, "before1", p1, "pair", "word")
    p2 = checkpointed(p2)
    p3, w3 = _level(grams, "before2", p2, "triple", "pair")
    left = w1.first()
    unknown = float(left["chance"]) * floor if left else floor
    return Model({kind: _gathered(table) for kind, table in zip(KEY_KINDS, (p1, p2, p3, w2, w3))}, unknown)


def perplexities(docs: DataFrame, model: Model | ShardedModel, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and each row's ``n_tokens`` and ``perplexity``; with a model in tasks nothing is shuffled, with a larger one rows are stored."""
    if isinstance(model, ShardedModel):
        return _sharded_perplexities(docs, model, keep)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.coalesce("text", F.lit("")).alias("_read"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, totals = [], []
            for _, texts in _groups(batch.column(0).cast(pa.binary()).to_pylist()):
                tokens, counts = _token_rows(texts)
                sizes.append(counts)
                totals.append(np.add.reduceat(sent.value.log_chances(tokens, counts), np.cumsum(counts) - counts))
            if sizes:
                n = np.concatenate(sizes)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[1:], pa.array(n, pa.int64()), pa.array(np.exp(-np.concatenate(totals) / n))],
                    names=[*batch.schema.names[1:], "n_tokens", "perplexity"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{kinds}, n_tokens bigint, perplexity double")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Numbers of rows that every label of theirs calls good and harmless."""
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("_good")).where("_good").select("doc_id")


def classifier(docs: DataFrame, labels: DataFrame, train_docs: int | None = None) -> tuple[Model | ShardedModel, DataFrame]:
    """The model, and the numbers of the trusted rows it was fitted on: all of one half, or at most ``train_docs`` of them if given."""
    order = F.xxhash64("doc_id")
    # The other half of the trusted rows stays unseen and sets the thresholds.
    chosen = trusted_ids(labels).where(F.pmod(order, F.lit(2)) == 0)
    chosen = checkpointed(chosen if train_docs is None else chosen.orderBy(order, "doc_id").limit(train_docs))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(sent_to_tasks(chosen, chosen.count()), "doc_id")
    return train(texts), chosen


def thresholds(scores: DataFrame, labels: DataFrame, chosen: DataFrame, quantile: float = QUANTILE,
               least: int = LEAST_TRUSTED) -> tuple[DataFrame, float | None]:
    """``lang`` and ``threshold``, and the threshold for all other languages, from trusted rows outside the fit."""
    known = checkpointed(
        scores.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "perplexity")
        .join(trusted_ids(labels), "doc_id").join(sent_to_tasks(chosen, chosen.count()), "doc_id", "left_anti"))
    cut = F.percentile_approx("perplexity", quantile, 10000)
    per = known.groupBy("lang").agg(cut.alias("threshold"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("n")
    return per, known.agg(cut).first()[0]


def quality_scores(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, train_docs: int | None = None) -> DataFrame:
    """``doc_id``, ``lang``, ``n_tokens``, ``perplexity``, ``threshold`` and ``accepted`` for every row.

    A trigram model with three discounts for each order is fitted on one half, by hash, of all trusted
    rows (label quality 1, not toxic; with ``train_docs`` on at most so many of them). A row is accepted if its
    perplexity is at most its language's ``quantile`` among trusted rows that the model has not seen.

    Whole texts are read; runs of signs are tokens of their own. A null text has its end as its only
    token. A language that is null or has few trusted rows takes the threshold of all trusted rows; without any trusted
    row the threshold is null and every row is accepted. Repeated rows are scored alike; null doc_ids are scored and never trusted;
    an empty table gives no rows.
    """
    model, chosen = classifier(docs, labels, train_docs)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    scores = perplexities(rows, model, ["doc_id", "lang"])
    scores = _kept_only(scores, model) if isinstance(model, ShardedModel) else checkpointed(scores)
    per, rest = thresholds(scores, labels, chosen, quantile)
    return accepted(scores, per, rest)


def _kept_only(scores: DataFrame, model: ShardedModel) -> DataFrame:
    """Stored scores, when nothing asks the model any more: its tables leave the disk."""
    dropped(scores.sparkSession, *model.paths)
    return scores


def accepted(scores: DataFrame, per: DataFrame, rest: float | None) -> DataFrame:
    per = checkpointed(per.select(F.col("lang").alias("_lang"), "threshold"))
    joined = scores.withColumn("_lang", F.coalesce("lang", F.lit(""))).join(
        sent_to_tasks(per, per.count()), "_lang", "left").drop("_lang")
    threshold = F.coalesce("threshold", F.lit(rest).cast("double"))
    return joined.withColumn("threshold", threshold).withColumn(
        "accepted", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))


def quality_decisions(docs: DataFrame, labels: DataFrame, keep: list[str], quantile: float = QUANTILE,
                      train_docs: int | None = None) -> DataFrame:
    """The rows of ``docs`` (``text`` and ``keep``, which has ``doc_id`` and ``lang``) beside their score and decision.

    As ``quality_scores``, but texts stay beside their score: the thresholds come from a first pass
    that writes small rows, a second pass scores again, and no text is shuffled. Only if the model is too large for tasks,
    one pass writes the texts beside their scores.
    """
    model, chosen = classifier(docs, labels, train_docs)
    if isinstance(model, ShardedModel):
        known = _kept_only(perplexities(docs, model, [*keep, "text"]), model)
        per, rest = thresholds(known.withColumns({"doc_id": F.col("doc_id").cast("bigint"), "lang": F.col("lang").cast("string")}), labels, chosen, quantile)
        return accepted(known, per, rest)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    scores = checkpointed(perplexities(rows, model, ["doc_id", "lang"]))
    per, rest = thresholds(scores, labels, chosen, quantile)
    return accepted(perplexities(docs, model, [*keep, "text"]), per, rest)
