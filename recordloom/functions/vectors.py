"""Column builders for dense vectors (``array<float>`` or ``array<double>``)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from recordloom.functions.text import is_blank


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _as_double(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column | str, b: Column | str, clamp: bool = True) -> Column:
    """Cosine of two vectors; 0 where either has no length or is missing."""
    left, right = _as_double(a), _as_double(b)
    dot = _sum(F.zip_with(left, right, lambda x, y: x * y))
    norms = F.sqrt(_sum(F.transform(left, lambda x: x * x))) * F.sqrt(
        _sum(F.transform(right, lambda x: x * x))
    )
    value = F.when(norms > 0, dot / norms).otherwise(0.0)
    return clamp01(value) if clamp else value


def binarize(vector: Column | str, method: str = "threshold") -> Column:
    """1.0 / 0.0 per component: ``> 0`` for "threshold", ``>= 0`` for "sign"."""
    if method == "threshold":
        return F.transform(_as_double(vector), lambda x: F.when(x > 0, 1.0).otherwise(0.0))
    if method == "sign":
        return F.transform(_as_double(vector), lambda x: F.when(x >= 0, 1.0).otherwise(0.0))
    raise ValueError(f"unknown binarize method: {method}")


# Characters whose n-grams are hashed at once.
GRAM_BLOCK = 65_536


def _hash_ngrams(text: str, size: int, n: int) -> np.ndarray:
    padded = f" {text.lower()} "
    total = max(1, len(padded) - n + 1)
    vector, plain = np.zeros(size), np.zeros(size)
    for at in range(0, total, GRAM_BLOCK):
        grams = [padded[i : i + n] for i in range(at, min(total, at + GRAM_BLOCK))]
        hashes = np.fromiter((zlib.crc32(g.encode()) for g in grams), dtype=np.uint32, count=len(grams))
        slots = (hashes >> 1) % size
        vector += np.bincount(slots, weights=np.where(hashes & 1, 1.0, -1.0), minlength=size)
        plain += np.bincount(slots, minlength=size)
    norm = np.linalg.norm(vector)
    if norm == 0.0:  # opposite signs cancelled out: fall back on plain counts
        vector = plain
        norm = np.linalg.norm(vector)
    return (vector / norm).astype(np.float32)


def ngram_vector(text: Column | str, size: int = 64, n: int = 3, blank: str = "error") -> Column:
    """Unit vector of hashed character n-grams of the whole text. Blank text is an error, or null if ``blank`` is "null"."""
    if blank not in ("error", "null"):
        raise ValueError(f"unknown treatment of blank text: {blank}")

    @F.arrow_udf(ArrayType(FloatType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # One text at a time: a batch is never held as Python strings or lists of numbers.
        for batch in batches:
            vectors = np.zeros((len(batch), size), dtype=np.float32)
            for i, text in enumerate(batch):
                if text.is_valid:
                    vectors[i] = _hash_ngrams(text.as_py(), size, n)
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * size)
            yield pa.ListArray.from_arrays(ends, pa.array(vectors.reshape(-1)), mask=batch.is_null())

    value = F.col(text) if isinstance(text, str) else text
    if blank == "null":
        return encode(F.when(~is_blank(value), value))
    return encode(F.when(is_blank(value), F.raise_error(F.lit("cannot embed blank text"))).otherwise(value))
