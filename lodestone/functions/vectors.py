"""Vector arithmetic as columns, and embedders."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where the lengths differ, a vector is empty or has no length."""
    size = norm(a) * norm(b)
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fits & (size > 0), dot(a, b) / F.when(size > 0, size)).otherwise(F.lit(0.0))


def normalize(v: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / F.when(n > 0, n))).otherwise(F.transform(v, lambda x: x.cast("double")))


def pack(v: Column) -> Column:
    """A vector as bytes: little-endian 32-bit floats end to end, as stores of other engines keep them."""

    @F.pandas_udf("binary")
    def packed(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return packed(v)


def unpack(raw: Column) -> Column:
    """The vector of bytes that ``pack`` made; bytes left over behind the last component are no part of it."""

    @F.pandas_udf("array<float>")
    def unpacked(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4", len(b) // 4))

    return unpacked(raw)


def mean_pool(vectors: Column, mask: Column) -> Column:
    """The mean of the token vectors under a 0/1 mask; zeros where the mask is empty."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] > 0), lambda x: x["v"])
    count = F.size(kept)
    first = F.transform(F.element_at(vectors, 1), lambda x: F.lit(0.0))
    total = F.aggregate(kept, first, lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.when(count > 0, count).otherwise(1))


def cls_pool(vectors: Column) -> Column:
    """The first token's vector."""
    return F.element_at(vectors, 1)


def fake_embedding(text: Column) -> Column:
    """Four components from a digest: a stand-in embedder that needs no model."""
    digest = F.sha2(text, 256)
    return F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        lambda i: F.conv(F.substr(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0,
    )


def embed(df: DataFrame, embedder: Callable[[Column], Column], text_col: str = "text", out: str = "vec") -> DataFrame:
    """``df`` with an embedding per text; an embedder is a function from column to column (a pandas UDF will do)."""
    return df.withColumn(out, embedder(F.col(text_col)))


def representation_id(name: str, pooling: str, dim: int, seq: int, doc_prefix: str = "") -> str:
    """What makes two vectors comparable: model, pooling, geometry and the prefix documents get (as FNV-1a)."""
    tag = f"{name}+{pooling}+l2+d{dim}+s{seq}"
    if doc_prefix:
        h = 0x811C9DC5
        for b in doc_prefix.encode():
            h = (h ^ b) * 0x01000193 % (1 << 32)
        tag += f"+dp{h:08x}"
    return tag
