"""Vector functions: cosine as an expression, hashing embedders as Arrow UDFs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, StringType

EPSILON = 2.220446049250313e-16


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [0, 1]: 0 for unequal lengths, empty or zero vectors and negative values."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    norms = _sum(F.transform(a, lambda x: x * x)), _sum(F.transform(b, lambda x: x * x))
    dot = _sum(F.zip_with(a, b, lambda x, y: x * y))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / F.sqrt(norms[0] * norms[1])))
    fit = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms[0] > EPSILON) & (norms[1] > EPSILON)
    return F.when(fit, value).otherwise(0.0)


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a."""
    h = 0xCBF29CE484222325
    for x in data:
        h = (h ^ x) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a_all(texts: list[bytes]) -> np.ndarray:
    """64-bit FNV-1a of each text, all at once: byte after byte, the texts that still have one."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(-size, kind="stable")
    start, data = np.concatenate([[0], np.cumsum(size)[:-1]])[order], np.frombuffer(b"".join(texts), np.uint8)
    h = np.full(len(texts), 0xCBF29CE484222325, np.uint64)
    left = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), "left")  # texts longer than each place
    for k, n in enumerate(left.tolist()):
        h[:n] = (h[:n] ^ data[start[:n] + k]) * np.uint64(0x100000001B3)
    out = np.empty_like(h)
    out[order] = h
    return out


def hash_vector(text: str, dim: int) -> np.ndarray:
    return hash_vectors([text], dim)[0]


def hash_vectors(texts: list[str], dim: int) -> list[np.ndarray]:
    """Counts of each text's words by hash; each distinct word of the batch is hashed once."""
    split = [t.lower().split() for t in texts]
    words = list({w for ws in split for w in ws})
    place = dict(zip(words, (fnv1a_all([w.encode() for w in words]) % np.uint64(dim)).tolist(), strict=True))
    return [np.bincount([place[w] for w in ws], minlength=dim).astype(np.float32) if ws else np.zeros(dim, np.float32) for ws in split]


def hash_embed(dim: int):
    """UDF: counts of a text's words by hash, in ``dim`` buckets; null stays null."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            found = iter(hash_vectors([t for t in p if t is not None], dim))
            yield pd.Series([None if t is None else next(found) for t in p], dtype=object)

    return embed


@F.pandas_udf(StringType())
def fnv1a_text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """UDF: 64-bit FNV-1a of a text as a decimal number; null stays null."""
    for p in parts:
        found = iter(fnv1a_all([t.encode() for t in p if t is not None]).tolist())
        yield pd.Series([None if t is None else str(next(found)) for t in p], dtype=object)


@F.pandas_udf(StringType())
def url_key(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """UDF: every byte that is no ASCII letter or digit, percent-encoded."""
    code = {i: chr(i) if chr(i).isascii() and chr(i).isalnum() else f"%{i:02X}" for i in range(256)}
    for p in parts:
        yield p.map(lambda t: None if t is None else "".join(code[x] for x in t.encode()))


@F.pandas_udf(ArrayType(FloatType()))
def vector_from_bytes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """UDF: little-endian 32-bit floats; a torn last value is left out."""
    for p in parts:
        yield pd.Series([None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4") for b in p], dtype=object)


@F.pandas_udf(BinaryType())
def vector_to_bytes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for p in parts:
        yield p.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())
