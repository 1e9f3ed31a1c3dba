"""Language-model scores by context-tree weighting over bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.llm.blocks import (
    ASK_SCHEMA, NULL_ID, REPLY_SCHEMA, ask_batch, at_shards, crc_of_id, mixed, pack, per_block, per_shard, prefix_sums,
    read_block, replies_of, shard_count, substring_hash, text_blocks, unpack, with_replies,
)

DEPTH = 6  #: bytes of context; with the byte itself they fill seven of eight bytes of a key
BLOCK_BYTES = 8 << 20  #: the larger a block, the smaller the share of its pairs that it asks for
PIECE = 1 << 19
STEPS = 2048  #: a byte's log10 probability is kept in this many steps for a factor of ten
END = np.uint64(0)  #: stands for the end among word hashes


def held_out_id(doc_id: int | None) -> bool:
    """crc32 of the number as text leaves 2 modulo 7; a row without a number is learned from."""
    return doc_id is not None and crc_of_id(doc_id) % 7 == 2


def _pieces(ids: np.ndarray, lens: np.ndarray, body: bytes, depth: int) -> Iterator[tuple]:
    """Documents of a block in groups of about PIECE bytes.

    The model's text is the token sequence: lower-case words, a blank between two and a line end at
    last, behind ``depth`` line ends as the first context. Yields the first document's place, each
    document's bounds, the bytes, and the words' hashes with each document's number of them.
    """
    ends = np.cumsum(lens)
    at = 0
    pad = b"\n" * depth
    while at < len(ids):
        till = max(at + 1, int(np.searchsorted(ends, ends[at] - lens[at] + PIECE, "right")))
        texts, words = [], []
        for k in range(at, till):
            found = body[ends[k] - lens[k] : ends[k]].lower().split()
            words.append(len(found))
            texts.append(pad + b" ".join(found) + b"\n")
        data = np.frombuffer(b"".join(texts), np.uint8)
        stop = np.cumsum([len(t) for t in texts])
        start = np.concatenate([[0], stop[:-1]]) + depth
        # A blank or a line end closes each word; line ends without a word before them do not.
        closing = (data == 0x20) | (data == 0x0A)
        inner = ~closing
        first = np.flatnonzero(inner & np.concatenate([[True], closing[:-1]]))
        last = np.flatnonzero(inner & np.concatenate([closing[1:], [True]])) + 1
        yield at, start, stop, data, substring_hash(prefix_sums(data), first, last), np.array(words)
        at = till


def _codes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, depth: int) -> np.ndarray:
    """For each scored byte: the byte, then its context from the nearest byte on, in one number."""
    wide = data.astype(np.uint64)
    code = wide[depth:].copy()
    for back in range(1, depth + 1):
        code |= wide[depth - back : len(wide) - back] << np.uint64(8 * back)
    scored = np.zeros(len(data) + 1, np.int8)
    scored[start] += 1
    scored[stop] -= 1
    return code[np.cumsum(scored[depth:-1]) > 0]


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
    counts = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.int64)


def _weighed(keys: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(place, weights=learned, minlength=len(distinct)).astype(np.int64)


def _gram_shard(codes: np.ndarray, shards: int) -> np.ndarray:
    """Contexts that end in the same two bytes go together, so their subtree is whole in one shard."""
    return (mixed((codes >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(shards)).astype(np.int32)


def _word_shard(words: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(words) % np.uint64(shards)).astype(np.int32) + shards


def _block_counts(row: dict, depth: int, held_out: Callable):
    ids, lens, body = read_block(row)
    train = np.array([not held_out(None if i == NULL_ID else int(i)) for i in ids], np.float64)
    grams, words = [], []
    for at, start, stop, data, hashes, per_doc in _pieces(ids, lens, body, depth):
        own = train[at : at + len(start)]
        grams.append(_weighed(_codes(data, start, stop, depth), np.repeat(own, stop - start)))
        words.append(_weighed(np.append(hashes, END), np.append(np.repeat(own, per_doc), own.sum())))
    return _counted(grams), _counted(words)


def _send(row: dict, keys: np.ndarray, counts: np.ndarray, shard: np.ndarray):
    order = np.argsort(shard, kind="stable")
    names, packed = [], []
    for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
        names.append(int(shard[part[0]]))
        body = pack(np.diff(keys[part], prepend=np.uint64(0)))
        packed.append(np.array([len(part), len(body)], np.int64).tobytes() + body + pack(counts[part]))
    return names, packed


def _request(row: dict, shards: int, depth: int, held_out: Callable) -> pa.RecordBatch:
    (codes, n), (words, m) = _block_counts(row, depth, held_out)
    a = _send(row, codes, n, _gram_shard(codes, shards))
    b = _send(row, words, m, _word_shard(words, shards))
    return ask_batch(row["block_id"], a[0] + b[0], a[1] + b[1])


def _read(asked: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Keys and counts of all blocks one after the other, and where each block's end."""
    keys, counts, sizes = [], [], []
    for data in asked:
        n, size = np.frombuffer(data, np.int64, 2)
        keys.append(np.cumsum(unpack(data[16 : 16 + size], np.uint64), dtype=np.uint64))
        counts.append(unpack(data[16 + size :], np.int64))
        sizes.append(int(n))
    return np.concatenate(keys), np.concatenate(counts), np.cumsum(sizes)[:-1].tolist()


def _word_answers(asked: list[bytes]) -> list[bytes]:
    keys, counts, bounds = _read(asked)
    _, place = np.unique(keys, return_inverse=True)
    total = np.bincount(place, weights=counts).astype(np.int64)[place]
    return [pack(t) for t in np.split(total, bounds)]


def _word_totals(asked: list[bytes]) -> pa.RecordBatch:
    keys, counts, _ = _read(asked)
    _, total = _counted([(keys, counts)])
    return pa.RecordBatch.from_arrays([pa.array([int(total.sum())]), pa.array([int((total > 0).sum())])], names=["n", "v"])


# The tree

def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x of a half or more, by Stirling's series eight steps on."""
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


class Nodes:
    """Nodes of one depth: context and bits so far as a key, counts, and the weighted log probability."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.key, place = np.unique(key, return_inverse=True)
        n = len(self.key)
        self.zeros, self.ones = (np.bincount(place, weights=w, minlength=n) for w in (zeros, ones))
        self.kt = log_kt(self.zeros, self.ones)
        if below is None:
            self.weighted = self.kt
        else:
            self.weighted = np.logaddexp(self.kt, np.bincount(place, weights=below, minlength=n)) - np.log(2)
        self.leaf = below is None

    def mixed_with(self, key: np.ndarray, bit: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """Probability of each bit here, given its probability one depth further; a half where nothing was learned."""
        if not len(self.key):
            return deeper
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        known = self.key[at] == key
        zeros, ones = self.zeros[at], self.ones[at]
        own = (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1)
        if self.leaf:
            return np.where(known, own, 0.5)
        weight = np.exp(self.kt[at] - self.weighted[at]) / 2
        return np.where(known, weight * own + (1 - weight) * deeper, 0.5)

    def parents(self, mask: int) -> tuple:
        """What the nodes add to those one byte of context shorter."""
        return self.key & np.uint64(mask), self.zeros, self.ones, self.weighted


def _bits(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each code its eight bit positions: bits so far (with a leading one), and the next bit."""
    byte = (codes & np.uint64(255)).astype(np.int64)[:, None] | 256
    steps = np.arange(8)
    return (byte >> (8 - steps)).astype(np.uint64), ((byte >> (7 - steps)) & 1).astype(bool)


def _subtree(codes: np.ndarray, counts: np.ndarray, depth: int) -> list[Nodes]:
    """Depths ``depth`` down to 2 of the tree over the learned codes."""
    learned = counts > 0
    codes, counts = codes[learned], counts[learned].astype(np.float64)
    so_far, bit = _bits(codes)
    key = (codes & ~np.uint64(255))[:, None] | so_far
    each = np.broadcast_to(counts[:, None], bit.shape)
    levels = [Nodes(key.ravel(), np.where(bit, 0, each).ravel(), np.where(bit, each, 0).ravel(), None)]
    for shorter in range(depth - 1, 1, -1):
        levels.append(Nodes(*levels[-1].parents((1 << (8 * shorter + 8)) - 1)))
    return levels


def _crown(asked: list[bytes], depth: int) -> pa.RecordBatch:
    keys, counts, _ = _read(asked)
    codes, total = _counted([(keys, counts)])
    key, zeros, ones, weighted = _subtree(codes, total, depth)[-1].parents(0xFFFF)
    distinct, place = np.unique(key, return_inverse=True)
    sums = [np.bincount(place, weights=w, minlength=len(distinct)) for w in (zeros, ones, weighted)]
    return pa.RecordBatch.from_arrays([pa.array(distinct.astype(np.int64)), *map(pa.array, sums)], names=["key", "zeros", "ones", "below"])


def _gram_answers(crown: tuple, depth: int) -> Callable[[list[bytes]], list[bytes]]:
    """Log probabilities of the asked bytes in their contexts, in steps of 10 ** (-1 / STEPS)."""

    def answer(asked: list[bytes]) -> list[bytes]:
        keys, counts, bounds = _read(asked)
        codes, place = np.unique(keys, return_inverse=True)
        total = np.bincount(place, weights=counts).astype(np.int64)
        one = Nodes(*crown)
        levels = _subtree(codes, total, depth) + [one, Nodes(*one.parents(0xFF))]
        logs = np.empty(len(codes), np.uint16)
        for at in range(0, len(codes), 1 << 17):
            some = codes[at : at + (1 << 17)]
            so_far, bit = _bits(some)
            chance = np.full(bit.shape, 0.5)
            for length, level in zip(range(depth, -1, -1), levels):
                key = (some & np.uint64((1 << (8 * length + 8)) - 1) & ~np.uint64(255))[:, None] | so_far
                chance = level.mixed_with(key, bit, chance)
            logs[at : at + len(some)] = np.minimum(np.round(-np.log10(chance).sum(1) * STEPS), 65535)
        return [pack(x) for x in np.split(logs[place], bounds)]

    return answer


def _in_sent_order(values: list[bytes], shard: np.ndarray, kind) -> np.ndarray:
    out = np.zeros(len(shard), kind)
    if len(shard):
        out[np.argsort(shard, kind="stable")] = np.concatenate([unpack(v, kind) for v in values])
    return out


def _scores(row: dict, shards: int, depth: int, held_out: Callable, n: int, v: int) -> pa.RecordBatch:
    ids, lens, body = read_block(row)
    grams, words, texts = [], [], []
    for piece in _pieces(ids, lens, body, depth):
        at, start, stop, data, hashes, per_doc = piece
        code, place = np.unique(_codes(data, start, stop, depth), return_inverse=True)
        word, spot = np.unique(np.append(hashes, END), return_inverse=True)
        grams.append(code)
        words.append(word)
        texts.append((at, stop - start, per_doc, place.astype(np.int32), spot.astype(np.int32)))
    codes = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)
    known = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
    replies = sorted(row["replies"] or [], key=lambda r: r["shard"])
    logs = _in_sent_order([r["reply"] for r in replies if r["shard"] < shards], _gram_shard(codes, shards), np.uint16)
    counts = _in_sent_order([r["reply"] for r in replies if r["shard"] >= shards], _word_shard(known, shards), np.int64)
    columns = [np.zeros(len(ids), t) for t in (np.int64, np.int64, np.int64, np.float64, np.float64)]
    size, n_tokens, n_known, base, score = columns
    for (at, bytes_, per_doc, place, spot), code, word in zip(texts, grams, words):
        docs = slice(at, at + len(per_doc))
        each = logs[np.searchsorted(codes, code)].astype(np.int64)[place]
        score[docs] = -np.add.reduceat(each, np.cumsum(bytes_) - bytes_) / STEPS
        count = counts[np.searchsorted(known, word)][spot]
        end, count = count[-1], count[:-1]
        owner = np.repeat(np.arange(len(per_doc)), per_doc)
        chance = np.log10((np.append(count, end) + 1) / (n + v + 1))
        base[docs] = np.bincount(owner, weights=chance[:-1], minlength=len(per_doc)) + chance[-1]
        n_known[docs] = np.bincount(owner, weights=count > 0, minlength=len(per_doc)) + (end > 0)
        n_tokens[docs] = per_doc + 1
        size[docs] = bytes_
    names = [None if i == NULL_ID else int(i) for i in ids]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(names, pa.int64()), pa.array([held_out(i) for i in names], pa.bool_()),
            pa.array(n_tokens), pa.array(n_known), pa.array(np.full(len(ids), n, np.int64)),
            pa.array(base), pa.array(score), pa.array(-score * np.log2(10) / np.maximum(size, 1)),
        ],
        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
    )


SCORE_SCHEMA = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                "base_score double, score double, bits_per_byte double")


def context_tree_scores(docs: DataFrame, depth: int = DEPTH, held_out: Callable[[int | None], bool] = held_out_id) -> DataFrame:
    """Every row's log10 probability under a context tree of bytes learned from the rows that are not held out.

    The model's text is the row's token sequence: words between ASCII blanks with A-Z in
    lower case, one blank between words and a line end at last. Each byte is eight binary
    decisions; at every depth from 0 to ``depth`` bytes of context a node counts its zeros
    and ones, and the Krichevsky-Trofimov estimates of all depths are mixed with the
    weights that context-tree weighting gives them after the whole training text
    (half for the node itself, half for its longer contexts). ``bits_per_byte`` is the
    code length. ``base_score`` is the add-one unigram word model over the same tokens.

    Counts cover all training rows. Blocks send their distinct (context, byte) pairs with
    counts to shards by the last two context bytes, so subtrees are whole in a shard; contexts of
    one byte and none have at most 65,280 nodes, which go to every task. A pair's log
    probability comes back once for each block that has it, rounded to 1/2048 of a
    factor of ten; no byte is held less likely than 10 ** -32.

    Null and blank texts have the end as their only token. A null doc_id is learned from.
    Repeated rows count as often as they stand. Without training rows every bit
    has the chance of a half. An empty table gives no rows.
    """
    if not 2 <= depth <= 7:
        raise ValueError("depth must be between 2 and 7")
    blocks = text_blocks(docs, BLOCK_BYTES)
    shards = shard_count(blocks, 0.75)
    asked = at_shards(per_block(blocks, lambda row: _request(row, shards, depth, held_out), ASK_SCHEMA))
    words, grams = asked.where(F.col("shard") >= shards), asked.where(F.col("shard") < shards)
    body = lambda rows: [r["asked"] for r in rows]
    totals = per_shard(words, lambda rows: _word_totals(body(rows)), "n bigint, v bigint").agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    # At most 256 * 255 rows, whatever the corpus.
    top = (
        per_shard(grams, lambda rows: _crown(body(rows), depth), "key bigint, zeros double, ones double, below double")
        .groupBy("key").agg(F.sum("zeros"), F.sum("ones"), F.sum("below")).toPandas().to_numpy(dtype=np.float64)
    )
    crown = (top[:, 0].astype(np.uint64), top[:, 1], top[:, 2], top[:, 3])
    answer = _gram_answers(crown, depth)
    replies = per_shard(grams, lambda rows: replies_of(rows, answer(body(rows))), REPLY_SCHEMA).union(
        per_shard(words, lambda rows: replies_of(rows, _word_answers(body(rows))), REPLY_SCHEMA))
    n, v = int(totals[0]), int(totals[1])
    return per_block(
        with_replies(blocks, replies, "replies"), lambda row: _scores(row, shards, depth, held_out, n, v), SCORE_SCHEMA)
