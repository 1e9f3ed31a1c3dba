"""Removal of long repeated passages with a logarithmic family of sparse suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.llm.blocks import (
    ASK_SCHEMA, NULL_ID, answered, ask_batch, mixed, pack, per_block, prefix_sums, read_block, replies_in_order,
    shard_count, substring_hash, text_blocks, unpack, with_replies,
)
from diffloom.session import checkpointed

GRAM = 24  #: bytes that select and sort a sampled suffix; the longer, the fewer meet by chance
SEGMENT = 1 << 18  #: positions hashed at a time, whatever the length of a text
NEW, SEEN, UNSURE = 0, 1, 2


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, by doubling."""
    held, span = values, 1
    while span * 2 <= width:
        held = np.minimum(held[:-span], held[span:])
        span *= 2
    rest = width - span
    return np.minimum(held[: len(held) - rest], held[rest:]) if rest else held


def stretches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> Iterator[tuple]:
    """Stretches of neighbouring windows of ``length`` bytes with the same lowest gram of GRAM bytes.

    The lowest gram depends on a window's content alone, so equal windows in any two
    documents meet under the same key, and about one position in fourteen is sampled.
    Yields for each segment the hash sums with their offset, and the first window, last
    window and key of each stretch. Windows never cross documents. Where a stretch begins and
    ends only decides how windows are sent, never which are found.
    """
    n = len(data) - length + 1
    gram = min(GRAM, length)
    for at in range(0, max(n, 0), SEGMENT):
        till = min(at + SEGMENT, n)
        part = data[at : till + length - 1]
        sums = prefix_sums(part)
        grams = np.arange(len(part) - gram + 1)
        lowest = _lowest(substring_hash(sums, grams, grams + gram), length - gram + 1)
        whole = np.ones(till - at, bool)
        near = slice(np.searchsorted(ends, at, "right"), np.searchsorted(starts, till + length, "left"))
        for start, end in zip(starts[near], ends[near]):
            whole[max(start, end - length + 1, at) - at : max(min(end, till) - at, 0)] = False
        split = np.empty(len(whole), bool)
        split[0] = True
        split[1:] = (lowest[1:] != lowest[:-1]) | (whole[1:] != whole[:-1])
        first = np.flatnonzero(split)
        last = np.append(first[1:], len(whole)) - 1
        kept = whole[first]
        first, last = first[kept], last[kept]
        if len(first):
            yield at, sums, first, last, lowest[first]


def _positions(row: dict, length: int):
    """Stretches of a whole block: hash of their whole string, key, document place, first and last window."""
    ids, lens, body = read_block(row)
    data = np.frombuffer(body, np.uint8)
    ends = np.cumsum(lens)
    starts = ends - lens
    parts = []
    for at, sums, first, last, key in stretches(data, starts, ends, length):
        parts.append((substring_hash(sums, first, last + length), key, first + at, last + at))
    if parts:
        whole, key, first, last = (np.concatenate(x) for x in zip(*parts))
    else:
        whole = key = np.zeros(0, np.uint64)
        first = last = np.zeros(0, np.int64)
    return ids, starts, ends, data, whole, key, np.searchsorted(ends, first, "right"), first, last


def _earliest(values: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, the least document of each, and each value's place among them."""
    distinct, place = np.unique(values, return_inverse=True)
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, place, docs)
    return distinct, least, place


def _asked(shard: np.ndarray, docs: np.ndarray, *columns: np.ndarray) -> tuple[list[int], list[bytes], np.ndarray]:
    """Packed columns for each shard, by document inside; and the order in which they were sent."""
    order = np.lexsort((docs, shard))
    bounds = np.flatnonzero(np.diff(shard[order])) + 1
    shards, packed = [], []
    for part in np.split(order, bounds) if len(order) else []:
        shards.append(int(shard[part[0]]))
        steps = np.diff(docs[part], prepend=0)
        fields = [pack(steps)] + [np.ascontiguousarray(c[part]).tobytes() for c in columns]
        sizes = np.array([len(x) for x in fields], np.int64)
        packed.append(np.int64(len(fields)).tobytes() + sizes.tobytes() + b"".join(fields))
    return shards, packed, order


def _read_asked(data: bytes, *kinds) -> list[np.ndarray]:
    count = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, count, 8)
    at = np.concatenate([[0], np.cumsum(sizes)]) + 8 * (count + 1)
    fields = [data[at[i] : at[i + 1]] for i in range(count)]
    return [np.cumsum(unpack(fields[0], np.int64))] + [np.frombuffer(f, k) for f, k in zip(fields[1:], kinds)]


class Level:
    """A sorted array of sampled suffixes: the hash of each whole stretch and its key."""

    def __init__(self, whole: np.ndarray, key: np.ndarray):
        self.whole, at = np.unique(whole, return_index=True)
        self.key = key[at]

    def merged(self, other: "Level") -> "Level":
        return Level(np.concatenate([self.whole, other.whole]), np.concatenate([self.key, other.key]))

    def holds(self, whole: np.ndarray) -> np.ndarray:
        if not len(self.whole):
            return np.zeros(len(whole), bool)
        at = np.minimum(np.searchsorted(self.whole, whole), len(self.whole) - 1)
        return self.whole[at] == whole


class IndexFamily:
    """Levels of sorted suffix arrays; a new batch is scanned against each, then levels of like size merge.

    Each entry is rewritten once for each doubling, so n batches cost n log n work.
    """

    def __init__(self):
        self.levels: list[Level] = []

    def scan(self, whole: np.ndarray) -> np.ndarray:
        found = np.zeros(len(whole), bool)
        for level in self.levels:
            found |= level.holds(whole)
        return found

    def add(self, batch: Level) -> None:
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2].whole) <= 2 * len(self.levels[-1].whole):
            last = self.levels.pop()
            self.levels[-1] = self.levels[-1].merged(last)

    def shared_keys(self) -> np.ndarray:
        """Keys that stand over two or more different stretches."""
        level = Level(np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        for each in self.levels:
            level = level.merged(each)
        keys, counts = np.unique(level.key, return_counts=True)
        return keys[counts > 1]


def _stretch_answers(asked: list[bytes], batches: int = 8) -> list[bytes]:
    """For each stretch: seen whole in an earlier document, unsure (other stretches share its key), or new."""
    parts = [_read_asked(a, np.uint64, np.uint32) for a in asked]
    docs, whole, key = (np.concatenate(x) for x in zip(*parts))
    key = key.astype(np.uint64)
    code = np.full(len(docs), NEW, np.uint8)
    order = np.argsort(docs, kind="stable")
    family = IndexFamily()
    # Batches in document order; one document's stretches stay in one batch.
    cuts = np.searchsorted(docs[order], np.unique(docs[order[np.linspace(0, len(order) - 1, batches + 1).astype(int)[1:-1]]]), "left")
    for batch in np.split(order, cuts):
        if not len(batch):
            continue
        _, least, place = _earliest(whole[batch], docs[batch])
        seen = family.scan(whole[batch]) | (docs[batch] > least[place])
        code[batch[seen]] = SEEN
        family.add(Level(whole[batch], key[batch]))
    shared = family.shared_keys()
    if len(shared):
        at = np.minimum(np.searchsorted(shared, key), len(shared) - 1)
        code[(code == NEW) & (shared[at] == key)] = UNSURE
    bounds = np.cumsum([len(p[0]) for p in parts])[:-1]
    return [pack(c) for c in np.split(code, bounds)]


def _window_answers(asked: list[bytes]) -> list[bytes]:
    """For each window hash: whether an earlier document has it."""
    parts = [_read_asked(a, np.uint64) for a in asked]
    docs, window = (np.concatenate(x) for x in zip(*parts))
    _, least, place = _earliest(window, docs)
    bounds = np.cumsum([len(p[0]) for p in parts])[:-1]
    return [pack(c) for c in np.split((docs > least[place]).astype(np.uint8), bounds)]


def _shard_of(values: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(values) % np.uint64(shards)).astype(np.int32)


def _stretch_request(row: dict, shards: int, length: int):
    ids, _, _, _, whole, key, doc, _, _ = _positions(row, length)
    distinct, least, place = _earliest(whole, ids[doc])
    keys = np.empty(len(distinct), np.uint64)
    keys[place] = key
    rest = (mixed(keys) >> np.uint64(32)).astype(np.uint32)
    sent, packed, order = _asked(_shard_of(keys, shards), least, distinct, rest)
    return sent, packed, order


def _known(row: dict, shards: int, length: int):
    """Stretches of the block with their codes: whole stretches that an earlier document has are SEEN."""
    ids, starts, ends, data, whole, key, doc, first, last = _positions(row, length)
    distinct, least, place = _earliest(whole, ids[doc])
    code = np.zeros(len(distinct), np.uint8)
    if len(distinct):
        keys = np.empty(len(distinct), np.uint64)
        keys[place] = key
        order = np.lexsort((least, _shard_of(keys, shards)))
        code[order] = np.concatenate([unpack(r, np.uint8) for r in replies_in_order(row["codes"])])
    each = np.where(ids[doc] > least[place], SEEN, code[place])
    return ids, starts, ends, data, doc, first, last, each


def _unsure_windows(data, ids, doc, first, last, each, length):
    """Hash, place and document of every window in unsure stretches."""
    hashes, places, docs = [], [], []
    unsure = np.flatnonzero(each == UNSURE)
    lo = 0
    while lo < len(unsure):
        # Stretches inside one segment of bytes are hashed together.
        hi = max(lo + 1, int(np.searchsorted(first[unsure], first[unsure[lo]] + SEGMENT)))
        some = unsure[lo:hi]
        base = first[some[0]]
        sums = prefix_sums(data[base : last[some].max() + length])
        counts = last[some] - first[some] + 1
        at = np.repeat(first[some] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        hashes.append(substring_hash(sums, at - base, at - base + length))
        places.append(at)
        docs.append(np.repeat(ids[doc[some]], counts))
        lo = hi
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places), np.concatenate(docs)


def _window_request(row: dict, shards: int, length: int):
    ids, _, _, data, doc, first, last, each = _known(row, shards, length)
    window, _, docs = _unsure_windows(data, ids, doc, first, last, each, length)
    distinct, least, _ = _earliest(window, docs)
    sent, packed, _ = _asked(_shard_of(distinct, shards), least, distinct)
    return sent, packed


def _result(row: dict, shards: int, length: int) -> pa.RecordBatch:
    ids, starts, ends, data, doc, first, last, each = _known(row, shards, length)
    window, place, docs = _unsure_windows(data, ids, doc, first, last, each, length)
    change = np.zeros(len(data) + 1, np.int32)
    seen = each == SEEN
    np.add.at(change, first[seen], 1)
    np.add.at(change, last[seen] + length, -1)
    if len(window):
        distinct, least, at = _earliest(window, docs)
        order = np.lexsort((least, _shard_of(distinct, shards)))
        found = np.zeros(len(distinct), np.uint8)
        found[order] = np.concatenate([unpack(r, np.uint8) for r in replies_in_order(row["windows"])])
        hit = place[(found[at] > 0) | (docs > least[at])]
        np.add.at(change, hit, 1)
        np.add.at(change, hit + length, -1)
    gone = np.cumsum(change[:-1]) > 0
    removed, spans, kept = [], [], []
    body = data.tobytes()
    for start, end in zip(starts.tolist(), ends.tolist()):
        cut = gone[start:end]
        removed.append(count := int(cut.sum()))
        spans.append(int(cut[:1].sum()) + int((cut[1:] > cut[:-1]).sum()) if count else 0)
        kept.append(hashlib.sha256(data[start:end][~cut].tobytes() if count else body[start:end]).hexdigest())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([None if i == NULL_ID else int(i) for i in ids], pa.int64()),
            pa.array(ends - starts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string()),
        ],
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    )


RESULT_SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def repeated_passages(docs: DataFrame, length: int = 50) -> DataFrame:
    """Per row: bytes covered by a ``length``-byte string that also starts in a document with a smaller doc_id.

    Each text is UTF-8 bytes, a null text empty; matches never cross documents, overlaps
    count, and strings are judged on the input. Content-sampled suffixes (one gram of 24 bytes in
    about fourteen, chosen so that every ``length``-byte string contains one) are
    sorted by fingerprints of 64 bits. Each key shard indexes its suffixes in batches of
    document order: a new batch is scanned against the levels of a logarithmic family and
    levels of like size merge. A stretch of windows that an earlier document holds whole is settled; where
    only the key is shared, at the ends of a match, every window is looked up by itself.

    A block asks once for each distinct stretch, so a passage in a third of all
    documents costs its shard one entry for each block. A null doc_id is smaller than any
    number; rows with equal doc_id do not remove from each other; texts under ``length``
    bytes lose nothing; an empty table gives no rows.
    """
    blocks = text_blocks(docs)
    shards = shard_count(blocks, 0.75)
    ask = lambda make: lambda row: _batch(row, make(row, shards, length))
    first = answered(per_block(blocks, ask(_stretch_request), ASK_SCHEMA), _stretch_answers)
    coded = with_replies(blocks, checkpointed(first), "codes")
    second = answered(per_block(coded, ask(_window_request), ASK_SCHEMA), _window_answers)
    return per_block(with_replies(coded, second, "windows"), lambda row: _result(row, shards, length), RESULT_SCHEMA)


def _batch(row: dict, made) -> pa.RecordBatch:
    return ask_batch(row["block_id"], made[0], made[1])
