"""Embeddings as a column: a provider that Spark runs in Arrow batches, or feature hashing of words in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

#: Cells of vectors that are made at once.
CELLS = 1 << 20


def hashed_embeddings(texts: DataFrame, key: str, text: str, dim: int = 384) -> DataFrame:
    """(key, embedding): feature hashing of the words of each row (unique by ``key``), scaled to unit length; the work grows with the words alone, and no word leaves its task.

    A word's MD5 gives its cell (first seven digits) and its sign (the eighth).
    """
    return texts.select(key, hashed_embedding(F.col(text), dim).alias("embedding"))


def hashed_embedding(text: Column, dim: int) -> Column:
    """The vector of each text, see ``hashed_embeddings``."""

    @F.arrow_udf(ArrayType(FloatType()))
    def embed(words: pa.Array) -> pa.Array:
        rows = max(1, CELLS // dim)
        return pa.concat_arrays([_hashed(words[at : at + rows], dim) for at in range(0, max(1, len(words)), rows)])

    return embed(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def _hashed(words: pa.Array, dim: int) -> pa.Array:
    """The vectors of some rows' words; each different word is digested once."""
    coded = words.flatten().dictionary_encode()
    digests = [hashlib.md5(w.encode()).hexdigest() for w in coded.dictionary.to_pylist()]
    cell = np.array([int(h[:7], 16) % dim for h in digests], np.int64)
    sign = np.array([1.0 if h[7] < "8" else -1.0 for h in digests], np.float64)
    owner, word = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False)), coded.indices.to_numpy(zero_copy_only=False)
    sums = np.bincount(owner * dim + cell[word], sign[word], len(words) * dim).reshape(len(words), dim).astype(np.float64)  # of no words, integers
    norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    flat = np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0).astype(np.float32).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * dim, pa.int32()), pa.array(flat))


def embed_column(text: Column, provider: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 32) -> Column:
    """``array<float>`` of each text.  ``provider()`` loads a model once a Python worker and returns a function of a list of texts."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = provider()
        for part in parts:
            texts, out = part.fillna("").tolist(), []
            for at in range(0, len(texts), batch):
                out += [list(map(float, v)) for v in model(texts[at : at + batch])]
            yield pd.Series(out, index=part.index, dtype=object)

    return embed(text)


def embed_texts(texts: DataFrame, key: str, text: str, provider: Callable | None = None, dim: int = 384, batch: int = 32, known: DataFrame | None = None) -> DataFrame:
    """(key, embedding, digest) of each row (unique by ``key``): from ``provider``, or by feature hashing (``hashed_embeddings``) without one.

    A provider meets every different text once, and not at all if ``known`` (digest, embedding; of the same provider) has it.  A null text is embedded as an empty one.
    """
    rows = texts.select(key, F.coalesce(text, F.lit("")).alias("_text")).withColumn("digest", F.sha2("_text", 256))
    if provider is None and known is None:  # hashed where the text is read, which is less than to shuffle it
        return rows.select(key, hashed_embedding(F.col("_text"), dim).alias("embedding"), "digest")
    fresh = rows.select("digest", "_text").dropDuplicates(["digest"])
    if known is not None:
        fresh = fresh.join(known.select("digest"), "digest", "left_anti")
    if provider is None:
        made = hashed_embeddings(fresh, "digest", "_text", dim)
    else:
        made = fresh.select("digest", embed_column(F.col("_text"), provider, batch).alias("embedding"))
    if known is not None:
        made = made.unionByName(known.select("digest", "embedding").dropDuplicates(["digest"]))
    return rows.select(key, "digest").join(made, "digest").select(key, "embedding", "digest")
