"""Token sequences in training order: a keyed permutation gives slots, shards hold fixed strides."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.llm.blocks import NULL_ID, id_and_text, mixed, pack, unpack
from diffloom.llm.words import sent_to_tasks
from diffloom.operators.ordering import running_total
from diffloom.session import checkpointed, shuffles_removed, stored

SEQUENCE = 1024  #: tokens in a slot
SHARD_SLOTS = 4096
BLOCK_BYTES = 4 << 20
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEY = 7
LOTS = 6  #: shards are written in so many lots


class Tokenizer:
    """A byte-pair vocabulary read from a rank file on the driver and sent to the tasks."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.pattern, self.end = pattern, max(self.ranks.values()) + 1
        if self.end > 0xFFFF:
            raise ValueError("token numbers must fit two bytes")

    def encoder(self):
        import tiktoken

        return tiktoken.Encoding("corpus", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})


def permuted(numbers: np.ndarray, size: int, key: int, rounds: int = 4) -> np.ndarray:
    """A keyed one-to-one map of ``range(size)``: a Feistel network, walked on until inside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mixed(np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64(key * 0x9E3779B97F4A7C15 % 2**64))
    out = numbers.astype(np.uint64)
    open_ = np.arange(len(out))
    while len(open_):
        left, right = out[open_] >> np.uint64(half), out[open_] & mask
        for k in keys:
            left, right = right, left ^ (mixed(right + k) & mask)
        out[open_] = (left << np.uint64(half)) | right
        open_ = open_[out[open_] >= np.uint64(size)]
    return out.astype(np.int64)


def _token_blocks(batches: Iterator[pa.RecordBatch], sent, limit: int) -> Iterator[pa.RecordBatch]:
    encoder = sent.value.encoder()
    end = sent.value.end
    part, made = TaskContext.get().partitionId(), 0
    ids, tokens, held = [], [], 0

    def block() -> pa.RecordBatch:
        lens = np.array([len(t) for t in tokens], np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([(part << 32) + made], pa.int64()), pa.array([int(lens.sum())], pa.int64()),
             pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([lens.tobytes()], pa.binary()),
             pa.array([pack(np.concatenate(tokens))], pa.binary())],
            names=["block_id", "n", "ids", "lens", "tokens"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(NULL_ID if doc_id is None else doc_id)
            tokens.append(np.array([*encoder.encode_ordinary(text), end], np.uint16))
            held += len(text)
            if held >= limit:
                yield block()
                made += 1
                ids, tokens, held = [], [], 0
    if ids:
        yield block()


def _sequences(batches: Iterator[pa.RecordBatch], length: int, size: int, key: int, per_shard: int, end: int, shards: range):
    for batch in batches:
        for row in batch.to_pylist():
            tokens = unpack(row["tokens"], np.uint16)
            ids, lens = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lens"], np.int64)
            n = -(-len(tokens) // length)
            padded = np.full(n * length, end, np.uint16)
            padded[: len(tokens)] = tokens
            slots = permuted(np.arange(row["first"], row["first"] + n), size, key)
            stop = np.cumsum(lens)
            cuts = np.arange(n) * length
            first = np.searchsorted(stop, cuts, "right")
            last = np.searchsorted(stop, np.minimum(cuts + length, len(tokens)), "left")
            body = padded.astype("<u2").tobytes()
            wanted = np.flatnonzero((slots >= shards.start * per_shard) & (slots < shards.stop * per_shard))
            for at in range(0, len(wanted), 512):
                some = wanted[at : at + 512]
                docs = [[None if i == NULL_ID else i for i in ids[a : b + 1].tolist()] for a, b in zip(first[some], last[some])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(slots[some]), pa.array(slots[some] // per_shard), pa.array(slots[some] % per_shard * 2 * length),
                        pa.array(row["first"] + some),
                        pa.array(np.minimum(length, len(tokens) - cuts[some])),
                        pa.array(docs, pa.list_(pa.int64())),
                        pa.array([body[2 * length * k : 2 * length * (k + 1)] for k in some.tolist()], pa.binary()),
                    ],
                    names=["slot", "shard", "offset", "sequence", "n_tokens", "doc_ids", "ids"])


SEQUENCE_SCHEMA = ("slot bigint, shard bigint, offset bigint, sequence bigint, n_tokens bigint, "
                   "doc_ids array<bigint>, ids binary")


def _ordered(numbered: DataFrame, shards: range, length: int, size: int, key: int, per_shard: int, end: int) -> DataFrame:
    """The slots of some shards, each shard in a partition of its own, out of numbered token blocks."""
    made = numbered.mapInArrow(lambda b: _sequences(b, length, size, key, per_shard, end, shards), SEQUENCE_SCHEMA)
    return made.repartitionById(len(shards), (F.col("shard") - shards.start).cast("int")).sortWithinPartitions("shard", "slot")


def training_order(docs: DataFrame, tokenizer: Tokenizer | None = None, length: int = SEQUENCE,
                   per_shard: int = SHARD_SLOTS, key: int = KEY) -> DataFrame:
    """Every token of ``docs`` in sequences of ``length``, each at its global slot.

    Each text is tokenised once and closed by an end token; the tokens of a block of texts are packed
    end to end, and only a block's last sequence is filled up with end tokens. Sequences are
    numbered over all blocks, and a keyed Feistel network with cycle-walking over exactly that many
    numbers gives each its slot. ``shard`` and byte ``offset`` follow from the slot: every shard but the last
    holds ``per_shard`` slots of ``2 * length`` bytes (``ids``, little endian). Partition n holds shard n
    and no other, sorted by slot. ``sequence`` is the place before the shuffle, ``doc_ids`` the documents inside.

    Token blocks are written once to the shared folder, so a lost executor changes no number. A null
    or empty text is an end token alone; null doc_ids stay null in ``doc_ids``; repeated
    rows are written again; an empty table gives no rows.
    """
    numbered, size, end = _numbered(docs, tokenizer or Tokenizer(), length)
    return _ordered(numbered, range(max(1, -(-size // per_shard))), length, size, key, per_shard, end)


def _numbered(docs: DataFrame, tokenizer: Tokenizer, length: int) -> tuple[DataFrame, int, int]:
    """Token blocks with the number of their ``first`` sequence, the number of all sequences, and the end token."""
    spark = docs.sparkSession
    sent, end = spark.sparkContext.broadcast(tokenizer), tokenizer.end
    schema = "block_id bigint, n bigint, ids binary, lens binary, tokens binary"
    blocks = checkpointed(id_and_text(docs).mapInArrow(lambda b: _token_blocks(b, sent, BLOCK_BYTES), schema))
    counts = blocks.select("block_id", F.ceil(F.col("n") / length).cast("bigint").alias("count"))
    placed = running_total(counts, [], [F.col("block_id")], F.col("count"), "_end", "_size")
    size = placed.agg(F.coalesce(F.max("_size"), F.lit(0))).first()[0]
    # One small row for each block of some megabytes: the tokens stay where they are.
    firsts = sent_to_tasks(placed.select("block_id", (F.col("_end") - F.col("count")).alias("first")), blocks.count())
    return blocks.join(firsts, "block_id"), size, end


def written_in_lots(docs: DataFrame, folder: str, tokenizer: Tokenizer | None = None, length: int = SEQUENCE,
                    per_shard: int = SHARD_SLOTS, key: int = KEY, lots: int = LOTS) -> DataFrame:
    """``training_order`` of ``docs`` written to ``folder``, the rows as ``written`` gives them.

    Shards are written in ``lots``, one after the other. Each lot shuffles only the slots of its own shards and leaves its
    files and small rows, so that token blocks, files and one lot's shuffle are on disk together, not a whole shuffle.
    """
    spark = docs.sparkSession
    numbered, size, end = _numbered(docs, tokenizer or Tokenizer(), length)
    shards = max(1, -(-size // per_shard))
    cuts = sorted({shards * k // lots for k in range(lots + 1)})
    rows = []
    for some in map(range, cuts, cuts[1:]):
        with shuffles_removed(spark):
            rows.append(stored(written(_ordered(numbered, some, length, size, key, per_shard, end), folder), "slots"))
    return spark.read.parquet(*rows)


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


def written(sequences: DataFrame, folder: str) -> DataFrame:
    """Writes each shard's slots one after the other to ``folder``; returns the rows without ``ids``, with ``file``.

    The writing happens as the rows are read, and again if they are read again. A shard is written under a
    name of its task attempt and renamed when it is whole, so a repeated or lost task leaves no
    half file. ``folder`` must be one that all executors share.
    """
    kept = [c for c in sequences.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        shard, out = None, None

        def close():
            out.close()
            files.move(f"{root}/shard-{shard:06d}.bin.{attempt}", f"{root}/shard-{shard:06d}.bin")

        for batch in batches:
            shards = batch.column(batch.schema.get_field_index("shard")).to_pylist()
            for number, ids in zip(shards, batch.column(batch.schema.get_field_index("ids")).to_pylist()):
                if number != shard:
                    if out:
                        close()
                    shard = number
                    out = files.open_output_stream(f"{root}/shard-{shard:06d}.bin.{attempt}")
                out.write(ids)
            names = pa.array([f"shard-{n:06d}.bin" for n in shards])
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], names], names=[*kept, "file"])
        if out:
            close()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sequences.select(*kept).schema.fields)
    return sequences.mapInArrow(run, f"{schema}, file string")


def write_shards(sequences: DataFrame, folder: str) -> DataFrame:
    """Writes the shards; one manifest row for each: ``shard``, ``file``, ``first_slot``, ``slots``."""
    return written(sequences, folder).groupBy("shard", "file").agg(
        F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("slots"))


def read_shards(spark: SparkSession, folder: str, length: int = SEQUENCE, per_shard: int = SHARD_SLOTS,
                from_slot: int = 0) -> DataFrame:
    """``slot`` and ``tokens`` from ``from_slot`` on; shards before it are not opened, earlier slots are skipped by stride."""
    first = from_slot // per_shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = int(row["path"].rsplit("-", 1)[1].split(".")[0])
                tokens = np.frombuffer(row["content"], "<u2").reshape(-1, length)
                slots = np.arange(len(tokens)) + shard * per_shard
                keep = slots >= from_slot
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slots[keep]), pa.array(tokens[keep].astype(np.int32).tolist(), pa.list_(pa.int32()))],
                    names=["slot", "tokens"])

    shard_number = F.regexp_extract("path", r"shard-(\d+)\.bin$", 1).cast("bigint")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(folder)
    return files.where(shard_number >= first).select("path", "content").mapInArrow(run, "slot bigint, tokens array<int>")
