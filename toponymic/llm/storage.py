"""Written tables in the cluster's shared folder, used where a result is read twice."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from toponymic.session import checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which all machines see."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    This cuts the lineage: what follows reads files that outlive any executor. The files
    stay, as the returned frame is lazy; the owner of the folder clears it.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
