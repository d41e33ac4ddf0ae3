"""Splitting a table into contiguous ranges of an integer key, one range a task.

The bounds come from a quantile sketch of the key column alone, so the texts are moved
once and never sampled. What reaches the driver is one row per range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "__part"


def ranges(df: DataFrame) -> int:
    """As many ranges as the session has shuffle partitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most ``n - 1`` rising key values that cut the keys into about equal ranges."""
    if n < 2:
        return []
    at = [i / n for i in range(1, n)]
    row = df.agg(F.percentile_approx(F.col(key).cast("long"), at, max(10000, 20 * n)).alias("q")).first()
    return sorted(set(row["q"] or []))


def range_of(key: Column, cuts: list[int]) -> Column:
    """Number of the range that holds the key; a null key belongs below every other."""
    marks = np.array(cuts, dtype=np.int64)

    @F.pandas_udf(T.IntegerType())
    def place(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), dtype=np.int32)
        out[known] = np.searchsorted(marks, ids[known].to_numpy(dtype=np.int64), side="right")
        return pd.Series(out)

    return place(key.cast("long"))
