"""Corpus tables as Spark sees them, spread over the cluster's cores.

A large corpus arrives in many files and row groups, so its scan already has many
partitions and nothing is done here. A small input (one file with one row group, as in
the test tables) scans as one task; it is hash-partitioned by its key so the per-row work
(tokenising, matching) runs on every core. Hash partitioning by ``doc_id`` is
deterministic on retry and lets later per-document aggregations reuse it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# Partitions per core for a small input: documents differ a lot in length.
SPLITS_PER_CORE = 4


def spread(df: DataFrame, *key: str) -> DataFrame:
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:   # no driver-side context (e.g. a Spark Connect session): leave as is
        return df
    if splits >= cores:
        return df
    return df.repartition(cores * SPLITS_PER_CORE, *key)
