"""Vectors of texts by any encoder, a batch at a time, the encoder loaded once for each worker.

An encoder is a factory: called on the worker, it loads what it needs and gives a function from
a list of texts to a matrix. ``hashed`` stands in where no model is at hand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from loomspark.functions import text as T

Encoder = Callable[[list[str]], np.ndarray]
#: Places of the hashed encoder, and texts that an encoder sees at once.
DIM, BATCH = 384, 64


def hashed(dim: int = DIM) -> Callable[[], Encoder]:
    """Token counts in md5 buckets, scaled to length 1; the texts are tokens with blanks between."""

    def load() -> Encoder:
        place = lru_cache(maxsize=1 << 20)(lambda token: int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16) % dim)

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for row, text in zip(out, texts):
                for token in text.split():
                    row[place(token)] += 1
            norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
            return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)

        return encode

    return load


def encode(rows: DataFrame, text: Column, load: Callable[[], Encoder], out: str = "embedding", batch: int = BATCH) -> DataFrame:
    """rows with the vector of a text, so many texts to a call; a null text is encoded as an empty one."""

    def make():
        encoder = load()
        return lambda texts: np.asarray(encoder([str(t) for t in texts]), dtype=np.float64)

    predict = predict_batch_udf(make, return_type=ArrayType(DoubleType()), batch_size=batch)
    return rows.withColumn(out, predict(F.coalesce(text, F.lit(""))))


def tokens_as_text(text: Column) -> Column:
    """What the hashed encoder reads of a text: its retrieval tokens."""
    return F.array_join(T.retrieval_tokens(text), " ")
