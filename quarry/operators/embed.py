"""Offline embeddings by feature hashing, with the interface of any batch encoder."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

DIM = 256


def encode(texts: list[str | None], dim: int = DIM) -> np.ndarray:
    """Unit vectors of hashed words; zeros for texts without words."""
    import xxhash

    from quarry.operators.fts_query import split_terms

    out = np.zeros((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        for w in split_terms(t or ""):
            h = xxhash.xxh3_64_intdigest(w)
            out[i, h % dim] += 1 if h >> 63 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def embedding(text: str | Column, encoder: Callable[[list[str | None]], np.ndarray] = encode) -> Column:
    """Each text's vector by an encoder: a function that can be pickled, of a batch of texts, rows of one length."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, np.float32) for v in encoder(s.tolist())])

    return run(text)
