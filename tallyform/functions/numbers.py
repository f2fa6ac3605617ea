"""Rounding as the evaluated scores have it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column | str, places: int) -> Column:
    """Half-even rounding of the scaled binary value.

    Built-in round and bround go by the shortest decimal text, so 2.675 becomes 2.68; its binary
    value is below the tie and belongs to 2.67, which this gives.
    """
    scale = 10.0**places
    return F.rint((F.col(c) if isinstance(c, str) else c) * scale) / scale
