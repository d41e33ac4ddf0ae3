"""Gazetteer and country table derived from the driver's tables.

The driver ships no geographic data, so the test gazetteer is built from ``benchmark``
text, deterministically and identically in the SQL oracle:

* countries: word runs of 2 to 5 characters, ranked by count (desc) then text (asc);
  rank k = 0..24 gives ``iso = 'N' || k`` and ``nation.n_nationkey = k`` its display name;
* places: distinct word runs of at least 6 characters ordered by text, ``row_index``
  0..n-1 in that order, then every distinct two-word match of ``W{4,} W{4,}`` ordered by
  text, numbered from n; ``countrycode = 'N' || (row_index % 25)``; the other gazetteer
  columns are simple functions of ``row_index``.

Documents play the articles; ``lang`` and ``source`` stand in for journal and
publication type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from toponymic.functions.words import word_runs
from toponymic.operators.indexing import with_dense_index

# Fixed values of the fixture derivation (shared with the SQL oracle).
N_COUNTRIES = 25
COUNTRY_MIN_LEN, COUNTRY_MAX_LEN = 2, 5
PLACE_MIN_LEN = 6
TWO_WORD_NAME = r"[\p{L}\p{N}_]{4,} [\p{L}\p{N}_]{4,}"
GEONAMEID_BASE = 5_000_000

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _benchmark_runs(benchmark: DataFrame) -> DataFrame:
    return (benchmark.select(F.explode_outer(word_runs("text")).alias("tok"))
                     .where(F.col("tok").isNotNull()))


def fixture_countries(benchmark: DataFrame, nation: DataFrame) -> DataFrame:
    """(iso, country, country_name, regionkey) – 25 rows, a top-k by design."""
    counts = (_benchmark_runs(benchmark)
              .where(F.length("tok").between(COUNTRY_MIN_LEN, COUNTRY_MAX_LEN))
              .groupBy("tok").agg(F.count(F.lit(1)).alias("n")))
    top = counts.orderBy(F.desc("n"), F.asc("tok")).limit(N_COUNTRIES)
    ranked = top.withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), F.asc("tok"))) - 1)
    return (ranked.join(nation, ranked.k == nation.n_nationkey, "left")
                  .select(F.concat(F.lit("N"), F.col("k").cast("string")).alias("iso"),
                          F.col("tok").alias("country"),
                          F.col("n_name").alias("country_name"),
                          F.col("n_regionkey").alias("regionkey")))


def fixture_places(benchmark: DataFrame) -> DataFrame:
    """Gazetteer rows: row_index, geonameid, name, asciiname, latitude, longitude,
    population, countrycode."""
    one = (_benchmark_runs(benchmark).where(F.length("tok") >= PLACE_MIN_LEN)
           .select(F.col("tok").alias("name")).distinct())
    two = (benchmark.select(F.explode_outer(F.regexp_extract_all("text", F.lit(TWO_WORD_NAME), 0)).alias("name"))
           .where(F.col("name").isNotNull()).distinct())
    ordered = (one.withColumn("part", F.lit(0))
               .unionByName(two.withColumn("part", F.lit(1))))
    indexed = with_dense_index(ordered, [F.col("part"), F.col("name")])
    r = F.col("row_index")
    return indexed.select(
        r,
        (F.lit(GEONAMEID_BASE) + r).cast("long").alias("geonameid"),
        F.col("name"),
        F.col("name").alias("asciiname"),
        ((r % 180) - 90).cast("double").alias("latitude"),
        ((r % 360) - 180).cast("double").alias("longitude"),
        (F.length("name") * 1000 + r).cast("long").alias("population"),
        F.concat(F.lit("N"), (r % N_COUNTRIES).cast("string")).alias("countrycode"),
    )
