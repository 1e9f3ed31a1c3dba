"""Text blocks, and questions that blocks ask of key-range shards.

Several operators must look up facts about *every* window, shingle or n-gram of a
corpus. One row for each of them would shuffle many times the corpus. Here documents
are packed into compressed blocks; a block sends one packed array of its distinct
keys to each shard, the shard answers with one packed array in the same order, and
the block reads its answers beside its own text. Shards see every key of the corpus,
blocks see every answer, and no task holds more than a block or a shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.session import checkpointed

NULL_ID = -(2**63)  #: stands for a null doc_id inside blocks; sorts before every other
BLOCK_BYTES = 4 << 20
BODY_LEVEL = 5  #: bodies are written and moved several times, compressed once
SHARD_BYTES = 96 << 20
BLOCK_SCHEMA = "block_id bigint, ids binary, lens binary, body binary"
ASK_SCHEMA = "shard int, block_id bigint, asked binary"
REPLY_SCHEMA = "block_id bigint, shard int, reply binary"


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text as the empty text; clashing extra columns fall away."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences, byte by byte: the high bytes of many keys cost nothing."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return pack(steps.view(np.uint8).reshape(-1, 8).T)


def unpack_sorted(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(unpack(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64)


def _pack_rows(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    ids: list[int] = []
    texts: list[bytes] = []
    held = made = 0

    def block() -> pa.RecordBatch:
        body = zstandard.ZstdCompressor(level=BODY_LEVEL).compress(b"".join(texts))
        lens = np.array([len(t) for t in texts], dtype=np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([(part << 32) + made], pa.int64()),
                pa.array([np.array(ids, dtype=np.int64).tobytes()], pa.binary()),
                pa.array([lens.tobytes()], pa.binary()),
                pa.array([body], pa.binary()),
            ],
            names=["block_id", "ids", "lens", "body"],
        )

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            ids.append(NULL_ID if doc_id is None else doc_id)
            texts.append(text)
            held += len(text)
            if held >= limit:
                yield block()
                made += 1
                ids, texts, held = [], [], 0
    if ids:
        yield block()


def text_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows of ``docs`` in compressed blocks of about ``block_bytes``.

    Written once to the shared folder, so that a block keeps its content and number
    whatever is recomputed later.
    """
    return checkpointed(packed_blocks(docs, block_bytes))


def packed_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``text_blocks`` before they are written."""
    return id_and_text(docs).mapInArrow(lambda batches: _pack_rows(batches, block_bytes), BLOCK_SCHEMA)


def shard_count(blocks: DataFrame, bytes_per_byte: float) -> int:
    """Shards so that each gets about SHARD_BYTES if a byte of text asks ``bytes_per_byte``."""
    octets = blocks.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    return max(shuffle_partitions(blocks), -(-int(3 * octets * bytes_per_byte) // SHARD_BYTES))


def read_block(row: dict) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Document numbers, text lengths in bytes, and the texts in one string."""
    ids = np.frombuffer(row["ids"], dtype=np.int64)
    lens = np.frombuffer(row["lens"], dtype=np.int64)
    return ids, lens, zstandard.ZstdDecompressor().decompress(row["body"])


def per_block(frame: DataFrame, make: Callable[[dict], pa.RecordBatch | None], schema: str) -> DataFrame:
    """One record batch for each block row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                made = make(batch.slice(at, 1).to_pylist()[0])
                if made is not None and made.num_rows:
                    yield made

    return frame.mapInArrow(run, schema)


def ask_batch(block_id: int, shards: list[int], asked: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(shards, pa.int32()), pa.array([block_id] * len(shards), pa.int64()), pa.array(asked, pa.binary())],
        names=["shard", "block_id", "asked"],
    )


def answered(asked: DataFrame, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """Each shard's replies, in the order of what the blocks asked."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block_id", kind="stable")
        return pd.DataFrame({
            "block_id": group["block_id"].to_numpy(),
            "shard": group["shard"].to_numpy(),
            "reply": answer(list(group["asked"])),
        })

    return asked.groupBy("shard").applyInPandas(run, REPLY_SCHEMA)


def at_shards(asked: DataFrame) -> DataFrame:
    """Requests brought to their shards once and kept there, for several passes without a shuffle each.

    All requests of a shard lie in one partition, one after the other; the checkpoint keeps that.
    """
    return checkpointed(asked.repartition(shuffle_partitions(asked), "shard").sortWithinPartitions("shard", "block_id"))


def per_shard(asked: DataFrame, make: Callable[[list[dict]], pa.RecordBatch], schema: str) -> DataFrame:
    """One record batch for each shard of what ``at_shards`` gave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["shard"] != row["shard"]:
                    yield make(held)
                    held = []
                held.append(row)
        if held:
            yield make(held)

    return asked.mapInArrow(run, schema)


def replies_of(rows: list[dict], replies: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r["block_id"] for r in rows], pa.int64()), pa.array([r["shard"] for r in rows], pa.int32()), pa.array(replies, pa.binary())],
        names=["block_id", "shard", "reply"])


def with_replies(blocks: DataFrame, replies: DataFrame, name: str) -> DataFrame:
    """Blocks beside the list of their replies; a block that asked nothing has an empty list."""
    listed = replies.groupBy("block_id").agg(F.collect_list(F.struct("shard", "reply")).alias(name))
    return blocks.join(listed, "block_id", "left")


def replies_in_order(listed: list[dict] | None) -> list[bytes]:
    return [r["reply"] for r in sorted(listed or [], key=lambda r: r["shard"])]


# Hashes over byte strings

_BASE = 0x9E3779B97F4A7C15
_tables = {"power": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}


def _table(name: str, size: int) -> np.ndarray:
    if len(_tables[name]) < size:
        step = _BASE if name == "power" else pow(_BASE, -1, 2**64)
        grown = np.full(1 << (size - 1).bit_length(), np.uint64(step))
        grown[0] = 1
        _tables[name] = np.multiply.accumulate(grown)
    return _tables[name]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of byte times power, modulo 2**64; the difference of two gives a substring."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _table("power", len(data) + 1)[: len(data)], out=sums[1:])
    return sums


def substring_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings; equal content gives equal hashes wherever it stands."""
    raw = (sums[end] - sums[start]) * _table("inverse", len(sums))[start]
    return mixed(raw ^ ((end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))


def crc_of_id(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())
