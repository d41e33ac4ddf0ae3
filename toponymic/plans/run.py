"""Command-line job: match an article tree against a gazetteer and write CSV (M1, M5).

    python -m toponymic --articles DIR --places cities.txt --countries countryInfo.txt \\
        --out OUT [--strategy text|noun_phrases|entities] [--chunk 10000] [--tag p]

Without ``--chunk`` the whole corpus is one batch job writing one output; with it, the
corpus is read as a bounded file stream, ``--chunk`` files per micro-batch, one output
per chunk. Prints one JSON line with the run totals.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toponymic.operators.match import Gazetteer
from toponymic.operators.report import doc_match_counts, export_matches, run_totals
from toponymic.plans.jobs import STRATEGIES, match_corpus
from toponymic.session import get_session
from toponymic.sources.articles import META_FIELDS, article_docs, article_paths, path_slice, read_articles
from toponymic.sources.gazetteer import load_inputs, read_countries, read_places
from toponymic.sources.sinks import INDEX, chunk_path, read_csv, run_stamp, write_csv
from toponymic.streaming.chunked import run_chunked


def parse_args(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="toponymic", description=__doc__.split("\n\n")[0])
    p.add_argument("--articles", required=True, help="root of the article tree")
    p.add_argument("--places", required=True, help="gazetteer TSV (19 columns, no header)")
    p.add_argument("--countries", required=True, help="country TSV with ISO and Country columns")
    p.add_argument("--out", required=True, help="output folder")
    p.add_argument("--strategy", choices=STRATEGIES, default="text")
    p.add_argument("--tag", default="p", help="element whose text is matched")
    p.add_argument("--chunk", type=int, default=None, help="files per output chunk (stream mode)")
    p.add_argument("--prefix", default="", help="prefix of the run folder name")
    p.add_argument("--run-id", default=None, help="stream mode: name of the run; reuse it to resume")
    p.add_argument("--index", action="store_true", help="batch mode: a leading column of row numbers")
    p.add_argument("--regex-names", action="store_true", help="treat names as regular expressions")
    p.add_argument("--slice", default=None, metavar="OFFSET:COUNT",
                   help="batch mode: only COUNT articles from OFFSET, in path order (e.g. 899:100)")
    p.add_argument("--split-over", type=int, default=None, metavar="BYTES",
                   help="batch mode, full text: longer texts are matched in pieces, by many tasks")
    p.add_argument("--master", default=None, help="Spark master for a local run")
    return p.parse_args(argv)


def run(spark: SparkSession, args: argparse.Namespace) -> dict:
    if args.chunk:
        gaz = Gazetteer(read_places(spark, args.places), read_countries(spark, args.countries),
                        regex_names=args.regex_names)
        t = run_chunked(spark, args.articles, gaz, args.out, files_per_chunk=args.chunk, tag=args.tag,
                        on=args.strategy, prefix=args.prefix, run_id=args.run_id)
        return {"articles_total": t.articles_total, "articles_processed": t.articles_processed,
                "articles_with_match": t.articles_with_match, "total_matches": t.total_matches,
                "percent_complete": t.percent_complete, "outputs": t.chunks}
    docs, places, countries = load_inputs(spark, args.articles, args.places, args.countries, args.tag)
    if args.slice:      # F3: the paths are picked first, then only those articles are read
        offset, count = (int(v) for v in args.slice.split(":"))
        picked = path_slice(spark, args.articles, offset, count)
        docs = article_docs(read_articles(spark, args.articles, only=picked), args.tag)
    gaz = Gazetteer(places, countries, regex_names=args.regex_names)
    matches = match_corpus(docs, gaz, on=args.strategy, keep=tuple(META_FIELDS), split_over=args.split_over)
    export = export_matches(matches)
    path = write_csv(export, chunk_path(args.out, run_stamp(), 1, args.prefix),
                     index_by=["doc_id", "row_index"] if args.index else None)
    # totals from the written output (matches only) and the corpus paths: no second match
    fields = T.StructType([T.StructField(INDEX, T.LongType())] * args.index + export.schema.fields)
    written = read_csv(spark, path, fields).select("doc_id", "row_index")
    listed = article_paths(spark, args.articles)
    done = docs.select("doc_id") if args.slice else listed.select(F.col("path").alias("doc_id"))
    same_form = F.regexp_replace("doc_id", "^file:/+", "file:/")     # listings and scans differ in their slashes
    counts = doc_match_counts(done.select(same_form.alias("doc_id")), written.withColumn("doc_id", same_form))
    return {**run_totals(counts, listed).collect()[0].asDict(), "outputs": [path]}


def main(argv: list[str] | None = None) -> dict:
    args = parse_args(argv)
    spark = get_session(args.master, app="toponymic")
    result = run(spark, args)
    print(json.dumps(result))
    return result
