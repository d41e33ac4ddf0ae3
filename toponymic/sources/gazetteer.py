"""Gazetteer and country-table readers.

* Places: headerless tab-separated file, 19 typed columns, UTF-8. Quoting is off by
  default, so a stray ``"`` stays in its field instead of swallowing lines. ``NA``
  stays text. ``row_index`` is the 0-based line number in file order (dense), computed
  without a single-partition window (``operators.indexing``).
* Countries: tab-separated with a header holding ``ISO`` and ``Country``; a leading
  ``#`` on the header line is accepted and comment lines are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toponymic.operators.indexing import with_dense_index
from toponymic.sources.articles import article_docs, read_articles

_L, _D, _S = T.LongType(), T.DoubleType(), T.StringType()
PLACES_SCHEMA = T.StructType([T.StructField(n, t) for n, t in [
    ("geonameid", _L), ("name", _S), ("asciiname", _S), ("alternatenames", _S),
    ("latitude", _D), ("longitude", _D), ("featureclass", _S), ("featurecode", _S),
    ("countrycode", _S), ("cc2", _S), ("admin1code", _S), ("admin2code", _S),
    ("admin3code", _S), ("admin4code", _S), ("population", _L), ("elevation", _D),
    ("dem", _L), ("timezone", _S), ("modificationdate", _S)]])


def read_places(spark: SparkSession, path: str, quote: str = "") -> DataFrame:
    """The 19 gazetteer columns plus ``row_index`` (file order, 0-based)."""
    raw = (spark.read.schema(PLACES_SCHEMA)
                .option("sep", "\t").option("header", False)
                .option("quote", quote).option("encoding", "UTF-8")
                .csv(path)
                .select("*", F.col("_metadata.file_path").alias("__file"),
                        F.col("_metadata.file_block_start").alias("__block"),
                        F.monotonically_increasing_id().alias("__seq")))
    indexed = with_dense_index(raw, [F.col("__file"), F.col("__block"), F.col("__seq")])
    return indexed.select(*PLACES_SCHEMA.fieldNames(), "row_index")


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """(iso, country) and every other header column, all strings."""
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    is_header = F.col("line").rlike(r"^#?ISO\t") & F.col("line").contains("\tCountry")
    header = lines.where(is_header).limit(1).collect()   # one line to the driver
    if not header:
        raise ValueError(f"{path}: no header line with ISO and Country")
    names = [h.lstrip("#").strip() for h in header[0]["line"].split("\t")]
    fields = F.split(F.col("line"), "\t")
    data = lines.where(~F.col("line").startswith("#") & ~is_header & (F.length("line") > 0))
    cols = [F.get(fields, k).alias(n) for k, n in enumerate(names)]   # short lines: null
    table = data.select(*cols)
    return table.select(F.col("ISO").alias("iso"), F.col("Country").alias("country"),
                        *[c for c in names if c not in ("ISO", "Country")])


def load_inputs(spark: SparkSession, article_root: str, places_path: str, countries_path: str,
                tag: str = "p") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(article docs, places, countries)."""
    docs = article_docs(read_articles(spark, article_root), tag)
    return docs, read_places(spark, places_path), read_countries(spark, countries_path)
