"""Frames with columns computed from their texts, all other columns passed through."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from toponymic.llm import texts


def fresh(df: DataFrame, name: str) -> str:
    """A name with which no column of ``df`` begins, whatever its columns are called."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def with_columns(df: DataFrame, text_col: str, fields: list[T.StructField],
                 make: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """``df`` with more columns made from ``text_col``, batch by batch; map-only."""
    schema = T.StructType([*df.schema.fields, *fields])
    at, names = df.columns.index(text_col), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.small(batches, at):
            yield pa.RecordBatch.from_arrays([*batch.columns, *make(batch.column(at))], names=names)

    return df.mapInArrow(run, schema)
