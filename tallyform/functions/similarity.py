"""Token-sort similarity: 2 * LCS / (length + length) of texts with sorted tokens.

The tokens are sorted by built-in functions. The longest common subsequence runs bit-parallel over
Python's long integers in an Arrow UDF; it is handed nulls for pairs that need no fuzzy score, so
those cost next to nothing.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def token_sort(c: Column | str) -> Column:
    """Tokens in code point order, joined by single spaces."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.array_sort(F.filter(F.split(c, " "), lambda t: t != "")), " ")


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: zeros left in a bit row after one addition per character of b."""
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, ch in enumerate(b):
        places[ch] = places.get(ch, 0) | 1 << i
    mask = (1 << len(b)) - 1
    row = mask
    for ch in a:
        u = row & places.get(ch, 0)
        row = ((row + u) | (row - u)) & mask
    return len(b) - row.bit_count()


def _ratio(x: str | None, y: str | None, seen: dict[tuple[str, str], float]) -> float | None:
    if x is None or y is None:
        return None
    if (x, y) not in seen:
        total = len(x) + len(y)
        seen[x, y] = 2.0 * lcs_length(x, y) / total if total else 1.0
    return seen[x, y]


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * LCS / (len + len) as 0..1; null if either side is; two empty texts are equal."""
    seen: dict[tuple[str, str], float] = {}
    return pd.Series([_ratio(x, y, seen) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def indel_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    """indel_ratio of each pair of two equally long arrays."""
    seen: dict[tuple[str, str], float] = {}
    return pd.Series([None if x is None else [_ratio(p, q, seen) for p, q in zip(x, y)] for x, y in zip(a, b)], dtype="object")


def token_sort_ratio(a: Column | str, b: Column | str) -> Column:
    """Similarity 0..1 of two texts whatever the order of their tokens."""
    return indel_ratio(token_sort(a), token_sort(b))
