"""Text embedding as a plug: any Arrow-batched function of texts, and a hashing default."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

EmbedFunc = Callable[[list[str]], np.ndarray]
BATCH = 32


def hashing_embedder(width: int = 64) -> EmbedFunc:
    """Deterministic unit vectors from hashed words."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width), dtype="float32")
        for i, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = xxhash.xxh64_intdigest(word)
                out[i, h % width] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)

    return embed


def embedding(text: Column, embed: EmbedFunc | None = None, batch: int = BATCH) -> Column:
    """The embedding of a text column; texts go to the function ``batch`` at a time."""
    call = embed or hashing_embedder()

    @F.pandas_udf(ArrayType(FloatType()))
    def run(column: pd.Series) -> pd.Series:
        texts = column.fillna("").tolist()
        parts = [call(texts[i : i + batch]) for i in range(0, len(texts), batch)]
        return pd.Series(list(np.vstack(parts))) if parts else pd.Series([], dtype=object)

    return run(text)


def embed_distinct(df: DataFrame, text: str, embed: EmbedFunc | None = None, name: str = "vector") -> DataFrame:
    """Embed every distinct text once and join it back by digest, so copies cost nothing."""
    keyed = df.withColumn("_digest", F.sha2(F.coalesce(text, F.lit("")), 256))
    once = keyed.groupBy("_digest").agg(F.first(text).alias("_text")).select("_digest", embedding(F.col("_text"), embed).alias(name))
    return keyed.join(once, "_digest").drop("_digest")
