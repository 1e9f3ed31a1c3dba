"""Periodic runs of words, by internal pattern matching over a suffix array and a wavelet tree."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_WORDS = 1 << 18  #: short texts share one set of arrays up to this many words; a longer text has its own
SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class WaveletTree:
    """Counts and n-th values in ranges of a number sequence, for many ranges at once.

    Each bit, the highest first, sorts the sequence stably into zeros and ones; a range is followed
    down by the number of zeros before its ends.
    """

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for bit in reversed(range(bits)):
            one = ((values >> bit) & 1).astype(bool)
            zeros = np.concatenate([[0], np.cumsum(~one)])
            self.levels.append((bit, zeros))
            values = np.concatenate([values[~one], values[one]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of each range are less than ``bound``."""
        count = np.zeros(len(low), np.int64)
        for bit, zeros in self.levels:
            zero_low, zero_high = zeros[low], zeros[high]
            right = (bound >> bit) & 1 == 1
            count += np.where(right, zero_high - zero_low, 0)
            low = np.where(right, zeros[-1] + low - zero_low, zero_low)
            high = np.where(right, zeros[-1] + high - zero_high, zero_high)
        return count

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The value of each range that has ``n`` lesser ones; with ``below`` it is the range successor of a bound."""
        value = np.zeros(len(low), np.int64)
        for bit, zeros in self.levels:
            zero_low, zero_high = zeros[low], zeros[high]
            right = n >= zero_high - zero_low
            n = np.where(right, n - (zero_high - zero_low), n)
            value |= right.astype(np.int64) << bit
            low = np.where(right, zeros[-1] + low - zero_low, zero_low)
            high = np.where(right, zeros[-1] + high - zero_high, zero_high)
        return value


def _ahead(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words from x on equal those from y on."""
    size, found = len(levels[0]), np.zeros(len(x), np.int64)
    for k in reversed(range(len(levels))):
        a, b = np.minimum(x + found, size - 1), np.minimum(y + found, size - 1)
        same = (y + found < size) & (levels[k][a] == levels[k][b]) & (levels[k][a] >= 0)
        found += same.astype(np.int64) << k
    return found


def _behind(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words right before x equal those right before y."""
    found = np.zeros(len(x), np.int64)
    for k in reversed(range(len(levels))):
        a, b = x - found - (1 << k), y - found - (1 << k)
        same = (a >= 0) & (levels[k][np.maximum(a, 0)] == levels[k][b]) & (levels[k][b] >= 0)
        found += same.astype(np.int64) << k
    return found


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and size of the group of equal keys, for every place of a sorted array."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(edge, len(key)))
    return np.repeat(edge, size), np.repeat(size, size)


def find_runs(words: np.ndarray, lens: np.ndarray, least_words: int = 6, powers: int = 4) -> np.ndarray:
    """Runs of all texts: columns text, start, length, period; sorted by text, start, period.

    ``words`` holds the word numbers of the texts one after the other, ``lens`` their numbers of words.
    A run is a stretch of one text with least period q that no neighbour extends, at least
    ``max(least_words, powers * q)`` words long.

    The suffix array is refined by doubling: places are grouped by their text and next m words, for
    m = 1, 2, 4, ... Only groups of two and more are refined and kept. A run with period q holds, for one
    m, a dyadic block of m words (it starts at a multiple of m) whose copy q words on lies in the run
    too, with q between (2m-1)/(powers-1) and (4m-1)/(powers-1). Occurrences of the block in that window
    are found by range successors in the wavelet tree. Up to two are candidate periods themselves;
    three or more form a progression, and the period must carry the end, or the start, of the block's own
    repetition to that of the progression. Candidates are extended by the classes of all m, exactly.
    """
    if powers < 4:
        raise ValueError("powers must be 4 or more")
    none = np.zeros((0, 4), np.int64)
    total = len(words)
    if not total:
        return none
    ends = np.cumsum(lens)
    text = np.repeat(np.arange(len(lens)), lens)
    begin = np.repeat(ends - lens, lens)
    left = np.repeat(ends, lens) - np.arange(total)
    _, single = np.unique(text * (int(words.max()) + 1) + words, return_inverse=True)
    levels = [single]
    counts = np.bincount(single)
    # Two words, of which none stands once in its text.
    often = counts[single] > 1
    at = np.flatnonzero(often[:-1] & often[1:] & (left[:-1] >= 2))
    key = single[at] * len(counts) + single[at + 1]
    order = np.argsort(key, kind="stable")
    first, size = _groups(key[order]) if len(at) else (at, at)
    places = at[order][size > 1]
    if not len(places):
        return none
    first, size = _groups(key[order][size > 1])
    slots, m, asked = np.arange(len(places)), 2, []
    while len(slots):
        here = places[slots]
        classes = np.full(total, -1, np.int64)
        classes[here] = first
        levels.append(classes)
        block = (here - begin[here]) % m == 0
        asked.append(np.stack([here[block], np.full(block.sum(), m), first[block], first[block] + size[block]], axis=1))
        follows = np.where(left[here] >= 2 * m, classes[np.minimum(here + m, total - 1)], -1)
        key = first * (len(places) + 1) + follows + 1
        order = np.argsort(key, kind="stable")
        places[slots] = here[order]
        start, size = _groups(key[order])
        kept = (size > 1) & (follows[order] >= 0)
        first, size, slots = slots[start][kept], size[kept], slots[kept]
        m *= 2
    here, m, low, high = np.concatenate(asked).T
    longest = int(lens.max())
    tree = WaveletTree(places - begin[places], longest.bit_length())
    local = here - begin[here]
    nearest, farthest = -(-(2 * m - 1) // (powers - 1)), -(-(4 * m - 1) // (powers - 1)) - 1
    before = tree.below(low, high, np.minimum(local + nearest, longest))
    count = tree.below(low, high, np.minimum(local + farthest + 1, longest)) - before
    some = count > 0
    here, local, low, high, before, count, nearest, farthest = (
        x[some] for x in (here, local, low, high, before, count, nearest, farthest))
    one = tree.nth(low, high, before) - local
    two = tree.nth(low, high, before + np.minimum(count - 1, 1)) - local
    few, many = count < 3, count >= 3
    x, near, step = here[many], one[many], (two - one)[many]
    ends_by = near + _ahead(levels, x + near, x + near + step) - _ahead(levels, x, x + step)
    starts_by = near - _behind(levels, x + near, x + near + step) + _behind(levels, x, x + step)
    x = np.concatenate([here[few], here[few], x, x])
    period = np.concatenate([one[few], two[few], ends_by, starts_by])
    least = np.concatenate([nearest[few], nearest[few], nearest[many], nearest[many]])
    most = np.concatenate([farthest[few], farthest[few], farthest[many], farthest[many]])
    valid = (period >= least) & (period <= most) & (x + period < total)
    x, period = x[valid], period[valid]
    back = _behind(levels, x, x + period)
    length = back + period + _ahead(levels, x, x + period)
    long = length >= np.maximum(least_words, powers * period)
    start, length, period = (x - back)[long], length[long], period[long]
    # Of the periods of one stretch the least is its own.
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    found = np.stack([text[start], start - begin[start], length, period], axis=1)
    return found[order]


def _solved(ids: list, texts: list[list[bytes]], least_words: int, powers: int) -> pa.RecordBatch:
    numbers: dict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    lens = np.array([len(t) for t in texts], np.int64)
    words = np.fromiter((numbers[w] for t in texts for w in t), np.int64, int(lens.sum()))
    found = find_runs(words, lens, least_words, powers)
    offsets = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
    collapsed = []
    for k, own in enumerate(texts):
        runs = found[offsets[k] : offsets[k + 1]]
        if len(runs):
            # +1 where a dropped stretch begins, -1 behind it.
            edges = np.zeros(len(own) + 1, np.int64)
            np.add.at(edges, runs[:, 1] + runs[:, 3], 1)
            np.add.at(edges, runs[:, 1] + runs[:, 2], -1)
            kept = np.cumsum(edges[:-1]) == 0
            own = [own[i] for i in np.flatnonzero(kept)]
        collapsed.append(b" ".join(own))
    rows = pa.StructArray.from_arrays([pa.array(found[:, c]) for c in (1, 2, 3)], fields=list(_RUNS.value_type))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()), pa.array(lens),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows).cast(_RUNS),
            pa.array(collapsed, pa.binary()).cast(pa.string()),
        ],
        names=["doc_id", "n_words", "runs", "collapsed"],
    )


def periodic_runs(docs: DataFrame, least_words: int = 6, powers: int = 4) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` and ``collapsed`` for each row of ``docs``, over whole texts.

    Words are what stands between ASCII blanks (space, 0x09 to 0x0D), numbered from 0. ``runs`` are the
    stretches described at :func:`find_runs`, by start, then period. ``collapsed`` are the words left,
    joined by one space, when every run keeps only its first period.

    Texts are independent, so rows stay where they are and nothing is shuffled; the memory of a task is
    that of ``BATCH_WORDS`` words or of its longest text. A null text has no words, no runs and an empty
    ``collapsed``, like an empty or blank one. Null doc_ids and repeated rows give a row each; an empty
    table gives no rows; other columns fall away.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[list[bytes]] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                ids.append(doc_id)
                texts.append(text.split())  # bytes split at the six ASCII blanks
                held += len(texts[-1])
                if held >= BATCH_WORDS:
                    yield _solved(ids, texts, least_words, powers)
                    ids, texts, held = [], [], 0
        if ids:
            yield _solved(ids, texts, least_words, powers)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, SCHEMA)
