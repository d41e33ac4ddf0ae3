"""CSV sink for match tables.

One output per chunk: ``<out>/<prefix>run=<start time>/chunk=<k>/part-*.csv`` with a
header, UTF-8. The directory is the "file"; Spark writes it in parallel and commits it
atomically, so a retried task or a lost executor cannot leave half a chunk behind.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from toponymic.operators.indexing import with_dense_index


def run_stamp() -> str:
    """Start time of a run; microseconds keep two quick runs into one folder apart."""
    return datetime.now().strftime("%Y-%m-%d_%H-%M-%S_%f")


def chunk_path(out_dir: str, stamp: str, chunk: int, prefix: str = "") -> str:
    return f"{out_dir.rstrip('/')}/{prefix}run={stamp}/chunk={chunk}"


#: Quotes inside a field are doubled and blanks around it are kept, on both sides.
CSV_OPTIONS = {"header": True, "encoding": "UTF-8", "quote": '"', "escape": '"',
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


#: Name of the leading column of row numbers, which has no title in the reference's files.
INDEX = "index"


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", index_by: list[str] | None = None) -> str:
    """Writes one output. ``index_by`` adds a leading column of dense row numbers (from 0, in
    that order), which sorts the rows and keeps them until they are written."""
    if index_by:
        numbered = with_dense_index(df, index_by, INDEX)
        df = numbered.select(INDEX, *df.columns)
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)
    return path


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """What ``write_csv`` wrote; fields may hold line breaks and quotes."""
    return spark.read.schema(schema).options(**CSV_OPTIONS, multiLine=True).csv(path)
