"""Exports and aggregations over matches.

Aggregations group on small keys with map-side partial aggregation, so a hot key (one
country, one source holding a large share of the rows) is reduced inside each task
before the shuffle; distinct counts are planned by Spark as a two-level aggregation that
spreads a hot group over its distinct values first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Published column names of the match table.
EXPORT_PLACE_COLS = ["geonameid", "name", "asciiname", "latitude", "longitude", "population"]
META_COLS = ["year", "pub_type", "journal", "doi", "pmid"]


def export_matches(matches: DataFrame) -> DataFrame:
    """The six place columns, the five metadata columns and the gazetteer's
    ``row_index`` on each match. ``matches`` must carry the metadata columns (they ride
    along from the document row, so no join back to the corpus is needed)."""
    return matches.select("doc_id", *EXPORT_PLACE_COLS, *META_COLS, "row_index")


def doc_match_counts(docs: DataFrame, matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """A2: matches per document, zero included.

    A union of one zero row per document with one row per match, summed per document:
    a single shuffle on ``doc_id`` after map-side partial sums (no join).
    """
    zeros = docs.select(F.col(key).alias("doc_id"), F.lit(0).cast("long").alias("one"))
    ones = matches.select("doc_id", F.lit(1).cast("long").alias("one"))
    return zeros.unionByName(ones).groupBy("doc_id").agg(F.sum("one").alias("n_matches"))


def run_totals(counts: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """A1: one row of run totals. ``counts`` comes from ``doc_match_counts``: the documents
    processed, with or without matches. ``corpus`` lists all documents of the corpus, one
    row each, processed or not (by default the processed ones)."""
    done = counts.select(F.lit(0).cast("long").alias("listed"), F.lit(1).cast("long").alias("done"), "n_matches")
    listed = (corpus if corpus is not None else counts).select(
        F.lit(1).cast("long").alias("listed"), F.lit(0).cast("long").alias("done"), F.lit(0).cast("long").alias("n_matches"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = done.unionByName(listed).agg(
        total("listed").alias("articles_total"), total("done").alias("articles_processed"),
        F.count_if(F.col("n_matches") > 0).alias("articles_with_match"), total("n_matches").alias("total_matches"))
    percent = F.when(F.col("articles_total") > 0, F.round(100.0 * F.col("articles_processed") / F.col("articles_total"), 2))
    return sums.withColumn("percent_complete", percent)


def place_counts(matches: DataFrame, places: DataFrame) -> DataFrame:
    """A3 + J7: matches per gazetteer row, joined to the gazetteer (left, from the counts).

    The count is pre-aggregated per task; both sides are gazetteer-sized, and the planner
    broadcasts one only where its measured size allows.
    """
    counts = matches.groupBy("row_index").agg(F.count(F.lit(1)).alias("count"))
    info = places.select("row_index", "geonameid", "name", "countrycode")
    return counts.join(info, "row_index", "left").select("row_index", "geonameid", "name", "countrycode", "count")


def reporting_effort(matches: DataFrame, country_col: str = "countrycode", group_col: str = "lang") -> DataFrame:
    """A4: matches and distinct documents per country and group, with subtotals per
    country and a grand total (ROLLUP). Matches are reduced to one row per document,
    country and group before the rollup multiplies rows."""
    per_doc = matches.groupBy(F.col(country_col).alias("iso"), F.col(group_col).alias(group_col), "doc_id") \
                     .agg(F.count(F.lit(1)).alias("n"))
    return (per_doc.rollup("iso", group_col)
                   .agg(F.sum("n").alias("n_matches"),
                        F.countDistinct("doc_id").alias("n_docs")))


def union_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """Bag union of several runs' results, labelled by run; each row keeps its
    gazetteer ``row_index``."""
    out = None
    for label, df in runs.items():
        df = df.select(F.lit(label).alias("run"), *df.columns)
        out = df if out is None else out.unionByName(df)
    return out
