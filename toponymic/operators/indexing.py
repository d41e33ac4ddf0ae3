"""Dense 0-based row numbers in a given order, computed without a single-partition window.

``row_number()`` over an unpartitioned window moves every row into one task. Here the
table is range-partitioned by a global sort, each row gets its position inside its
partition, and a tiny per-partition count table (one row per partition) supplies the
offsets through a broadcast join. The order columns must be unique so that a recomputed
partition reproduces the same numbers.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PID, _MID, _OFF = "__pid", "__mid", "__offset"


def with_dense_index(df: DataFrame, order_by: list[str | Column], name: str = "row_index") -> DataFrame:
    ranked = (df.orderBy(*order_by)
                .withColumn(_PID, F.spark_partition_id())
                .withColumn(_MID, F.monotonically_increasing_id())
                .persist(StorageLevel.MEMORY_AND_DISK))
    sizes = ranked.groupBy(_PID).agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select(
        _PID,
        F.coalesce(F.sum("n").over(Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias(_OFF))
    # monotonically_increasing_id = partition id << 33 + position inside the partition
    position = F.col(_MID) - F.shiftleft(F.col(_PID).cast("long"), 33)
    return (ranked.join(F.broadcast(offsets), _PID)
                  .withColumn(name, (F.col(_OFF) + position).cast("long"))
                  .drop(_PID, _MID, _OFF))
