"""Article corpus reader (S1, S2) and article rows.

Files are read whole, one row per file, from a directory tree; only names ending in the
extension exactly (case-sensitive) are taken. The parser of
``operators.article_markup`` is lenient, so a malformed file or a DOCTYPE naming an
external DTD never fails the job.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toponymic.operators.article_markup import with_article_fields

META_FIELDS = ["year", "pub_type", "journal", "doi", "pmid"]


def article_reader(spark: SparkSession, ext: str = ".nxml", stream: bool = False, **options):
    reader = spark.readStream if stream else spark.read
    reader = (reader.format("text")
                    .option("wholetext", True)
                    .option("recursiveFileLookup", True)
                    .option("pathGlobFilter", f"*{ext}"))
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader


def article_paths(spark: SparkSession, root: str, ext: str = ".nxml") -> DataFrame:
    """(path): one row per article file under ``root``, listed without reading the files."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
                 .option("pathGlobFilter", f"*{ext}").load(root).select("path"))


def path_slice(spark: SparkSession, root: str, offset: int, count: int, ext: str = ".nxml") -> list[str]:
    """``count`` article paths from ``offset`` in path order (the walk order is
    arbitrary, path order makes a slice repeatable). Only paths are sorted; as many as
    the caller asks for reach the driver."""
    rows = article_paths(spark, root, ext).orderBy("path").offset(offset).limit(count).collect()
    return [r["path"] for r in rows]


def read_articles(spark: SparkSession, root: str, ext: str = ".nxml", only: list[str] | None = None) -> DataFrame:
    """(path, markup, relpath): one row per article file under ``root``, or of the paths
    ``only``; ``relpath`` is the path below ``root`` (the form the reference's corpus scan
    returns). Names that begin with ``_`` or ``.`` are hidden files to Spark and not read."""
    if only is not None and not only:
        raw = spark.createDataFrame([], "path string, markup string")
    else:
        raw = with_path(article_reader(spark, ext).load(root if only is None else only))
    below = root.rstrip("/") + "/"
    if "://" not in below and not below.startswith("file:"):
        below = os.path.abspath(below) + "/"
    return raw.select("*", F.substring_index(F.col("path"), below, -1).alias("relpath"))


def with_path(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("markup"))


def article_docs(articles: DataFrame, tag: str = "p") -> DataFrame:
    """One row per article: doc_id (the path), text of every ``tag`` element, and the
    five metadata fields (year, pub_type, journal, doi, pmid), from one parse."""
    parsed = with_article_fields(articles.select("path", "markup"), "markup", tag)
    return parsed.select(F.col("path").alias("doc_id"), "text", *[F.col("meta")[f].alias(f) for f in META_FIELDS])
