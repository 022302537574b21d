"""Indel similarity of strings: 2 * LCS / (m + n)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word step per character of ``b``."""
    if len(a) < len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(distance: int, total: int) -> float:
    """Similarity in [0, 1] with the rounding of a 0..100 score divided by 100."""
    if total == 0:
        return 1.0
    return (1.0 - distance / total) * 100.0 / 100.0


def within(distance: int, total: int, threshold: float) -> bool:
    """Neighbour test of the density clustering: 1 - similarity <= 1 - threshold, in doubles."""
    return 1.0 - ratio(distance, total) <= 1.0 - threshold


@F.pandas_udf(DoubleType())
def _indel(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
        else:
            total = len(x) + len(y)
            out.append(ratio(total - 2 * lcs_length(x, y), total))
    return pd.Series(out, dtype="float64")


def indel_similarity(a: Column | str, b: Column | str) -> Column:
    return _indel(a, b)
