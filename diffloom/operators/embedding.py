"""Text to unit vectors.

The default embedder hashes words into buckets (feature hashing). The bucket of
a word is the first 32 bits of its md5 modulo the dimension, so any SQL engine
can reproduce a vector. A real model plugs in through :func:`model_embedder`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom import fixed_values as fv
from diffloom.functions import text as tx


def word_buckets(text: Column, dim: int = fv.EMBEDDING_DIM) -> Column:
    """array<int>: the bucket of every word, repeats kept."""

    def bucket(word: Column) -> Column:
        head = F.substring(F.md5(word.cast("binary")), 1, 8)
        return (F.conv(head, 16, 10).cast("bigint") % dim).cast("int")

    return F.transform(tx.words(text), bucket)


def bucket_counts(rows: list, dim: int) -> np.ndarray:
    """Count matrix (rows x dim) from ragged bucket lists, in one bincount."""
    sizes = np.fromiter((len(r) for r in rows), dtype=np.int64, count=len(rows))
    if not sizes.sum():
        return np.zeros((len(rows), dim))
    flat = np.concatenate([np.asarray(r, dtype=np.int64) for r in rows])
    offsets = np.repeat(np.arange(len(rows), dtype=np.int64) * dim, sizes)
    return np.bincount(flat + offsets, minlength=len(rows) * dim).reshape(len(rows), dim).astype(np.float64)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def hashing_embedding(text: Column, dim: int = fv.EMBEDDING_DIM) -> Column:
    """Unit vector of word counts; a text without words gives the zero vector."""

    @F.pandas_udf("array<float>")
    def to_vectors(buckets: pd.Series) -> pd.Series:
        vectors = unit_rows(bucket_counts(list(buckets), dim)).astype(np.float32)
        return pd.Series(list(vectors), index=buckets.index)

    return to_vectors(word_buckets(text, dim))


def model_embedder(
    load: Callable[[], Callable[[list[str]], np.ndarray]],
    dim: int = fv.EMBEDDING_DIM,
    batch: int = fv.EMBEDDING_BATCH,
    normalize: bool = True,
) -> Callable[[Column], Column]:
    """Wrap a user model as an embedding function over a text column.

    ``load`` runs once per Python worker and returns ``encode(texts) -> matrix``.
    A text on which the model fails gets the zero vector and does not fail the job.
    """

    @F.pandas_udf("array<float>")
    def to_vectors(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()

        def encode_safely(texts: list[str]) -> np.ndarray:
            try:
                return np.asarray(encode(texts), dtype=np.float64)
            except Exception:
                if len(texts) == 1:
                    return np.zeros((1, dim))
                return np.vstack([encode_safely([text]) for text in texts])

        for texts in series:
            values = ["" if t is None else t for t in texts]
            chunks = [encode_safely(values[i:i + batch]) for i in range(0, len(values), batch)]
            matrix = np.vstack(chunks) if chunks else np.zeros((0, dim))
            if normalize:
                matrix = unit_rows(matrix)
            yield pd.Series(list(matrix.astype(np.float32)), index=texts.index)

    return to_vectors


def embed(
    entries: DataFrame,
    text: str = "content",
    embedder: Callable[[Column], Column] = hashing_embedding,
    limit: int | None = None,
    out: str = "embedding",
) -> DataFrame:
    """Adds a unit vector per entry, made from the normalised text.

    The word-hashing default reads whole texts. A model with a bounded input
    passes its own ``limit`` in characters.
    """
    normalised = tx.code_text(tx.lines(F.coalesce(F.col(text), F.lit(""))), limit)
    return entries.withColumn(out, embedder(normalised))
