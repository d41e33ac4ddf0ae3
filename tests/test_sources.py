"""Readers, sink and the chunked stream: S1-S7, P4, and batch == stream."""

import glob
import os

import pytest

from fixtures import gazetteer
from toponymic.operators.report import export_matches
from toponymic.plans.jobs import match_corpus
from toponymic.sources.articles import META_FIELDS, article_docs, read_articles
from toponymic.sources.gazetteer import PLACES_SCHEMA, load_inputs, read_countries, read_places
from toponymic.sources.sinks import read_csv, write_csv
from toponymic.streaming.chunked import run_chunked

ARTICLE = ('<!DOCTYPE article PUBLIC "-//NLM//DTD v3.0//EN" "journalpublishing3.dtd"><article><front>'
           '<journal-title>J{i}</journal-title><article-id pub-id-type="pmid">{i}</article-id>'
           '<pub-date pub-type="epub"><year>201{i}</year></pub-date></front>'
           "<body><p>{text}</p></body></article>")
TEXTS = ["Cases in Nairobi, Kenya.", "Uganda: Fort Portal.", "Nothing here.", "Kenya and Uganda: Nairobi.",
         "Namibia; Windhoek"]


def write(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(content)


def make_corpus(root):
    subdirs = ["a/b", "a/b", "c", "c", "d/e/f"]
    for i, (sub, text) in enumerate(zip(subdirs, TEXTS)):
        write(f"{root}/{sub}/x{i}.nxml", ARTICLE.format(i=i, text=text))
    for name in ["x.NXML", "x.xml", "x.txt"]:
        write(f"{root}/c/{name}", ARTICLE.format(i=9, text="Kenya Nairobi"))


def test_article_scan_is_recursive_and_exact(spark, scratch):
    make_corpus(f"{scratch}/arts")
    rows = read_articles(spark, f"{scratch}/arts").collect()
    paths = sorted(r.path.split("/arts/")[1] for r in rows)
    assert paths == ["a/b/x0.nxml", "a/b/x1.nxml", "c/x2.nxml", "c/x3.nxml", "d/e/f/x4.nxml"]
    assert sorted(r.relpath for r in rows) == paths


def test_article_docs_meta(spark, scratch):
    make_corpus(f"{scratch}/arts")
    rows = {r.pmid: r for r in article_docs(read_articles(spark, f"{scratch}/arts")).collect()}
    assert rows["1"].year == 2011 and rows["1"].pub_type == "epub" and rows["1"].journal == "J1"
    assert rows["1"].text == "Uganda: Fort Portal.\n\n"


PLACE_LINES = [
    "184745\tNairobi\tNairobi\tNairobi,NBO\t-1.28\t36.81\tP\tPPLC\tKE\t\t05\t\t\t\t2750547\t\t1684\tAfrica/Nairobi\t2012-04-05",
    "186301\tMombasa\tMombasa\t\t-4.05\t39.66\tP\tPPLA\tKE\t\t19\t\t\t\t799668\t\t27\tAfrica/Nairobi\t2012-04-05",
    "3352136\tWindhoek\tWindhoek\t\t-22.55\t17.08\tP\tPPLC\tNA\t\t21\t\t\t\t268132\t\t1725\tAfrica/Windhoek\t2012-01-18",
    '232422\tKampala "Old\tKampala\t\t0.31\t32.58\tP\tPPLC\tUG\t\t\t\t\t\t1353189\t\t1155\tAfrica/Kampala\t2012-01-10',
]


def test_places_reader(spark, scratch):
    write(f"{scratch}/geo/cities.txt", "\n".join(PLACE_LINES * 3) + "\n")
    df = read_places(spark, f"{scratch}/geo/cities.txt")
    assert df.columns == PLACES_SCHEMA.fieldNames() + ["row_index"]
    rows = df.orderBy("row_index").collect()
    assert [r.row_index for r in rows] == list(range(12))
    assert [r.name for r in rows[:4]] == ["Nairobi", "Mombasa", "Windhoek", 'Kampala "Old']
    assert rows[2].countrycode == "NA" and rows[0].population == 2750547 and rows[0].latitude == -1.28


def test_places_row_index_dense_over_many_splits(spark, scratch):
    lines = [f"{i}\tP{i}\tP{i}\t\t0\t0\tP\tPPL\tKE\t\t\t\t\t\t{i}\t\t0\tX\t2012" for i in range(5000)]
    write(f"{scratch}/geo/big.txt", "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        df = read_places(spark, f"{scratch}/geo/big.txt")
        got = sorted((r.row_index, r.geonameid) for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(i, i) for i in range(5000)]


def test_countries_reader(spark, scratch):
    write(f"{scratch}/geo/countryInfo.txt",
          "# GeoNames country info\n# comment\n#ISO\tISO3\tCountry\tCapital\n"
          "KE\tKEN\tKenya\tNairobi\nNA\tNAM\tNamibia\tWindhoek\nUG\tUGA\tUganda\tKampala\n")
    rows = sorted((r.iso, r.country, r.Capital) for r in read_countries(spark, f"{scratch}/geo/countryInfo.txt").collect())
    assert rows == [("KE", "Kenya", "Nairobi"), ("NA", "Namibia", "Windhoek"), ("UG", "Uganda", "Kampala")]


def test_load_inputs_and_csv_sink(spark, scratch):
    make_corpus(f"{scratch}/arts")
    write(f"{scratch}/geo/cities.txt", "\n".join(PLACE_LINES) + "\n")
    write(f"{scratch}/geo/countryInfo.txt", "ISO\tCountry\nKE\tKenya\nNA\tNamibia\nUG\tUganda\n")
    docs, places, countries = load_inputs(spark, f"{scratch}/arts", f"{scratch}/geo/cities.txt",
                                          f"{scratch}/geo/countryInfo.txt")
    from toponymic.operators.match import Gazetteer
    m = export_matches(match_corpus(docs, Gazetteer(places, countries), keep=tuple(META_FIELDS)))
    path = write_csv(m, f"{scratch}/out/run=1/chunk=1")
    back = spark.read.option("header", True).csv(path)
    assert sorted((r.name, r.pmid) for r in back.collect()) == [("Nairobi", "0"), ("Nairobi", "3"), ("Windhoek", "4")]


def test_stream_chunks_equal_batch(spark, scratch):
    make_corpus(f"{scratch}/arts")
    gaz = gazetteer(spark)
    totals = run_chunked(spark, f"{scratch}/arts", gaz, f"{scratch}/out", files_per_chunk=2)
    assert len(totals.chunks) == 3
    assert totals.articles_processed == 5
    streamed = spark.read.option("header", True).csv([f"{c}/*.csv" for c in totals.chunks])
    batch = export_matches(match_corpus(article_docs(read_articles(spark, f"{scratch}/arts")), gaz,
                                        keep=tuple(META_FIELDS)))
    key = lambda r: (r.doc_id, r.row_index)
    assert sorted(map(key, streamed.collect())) == sorted((r.doc_id, str(r.row_index)) for r in batch.collect())
    assert totals.total_matches == batch.count()
    assert totals.articles_with_match == batch.select("doc_id").distinct().count()
    assert all(glob.glob(f"{c}/part-*.csv") for c in totals.chunks)


def test_command_line_job(spark, scratch):
    from toponymic.plans.run import parse_args, run
    make_corpus(f"{scratch}/arts")
    write(f"{scratch}/geo/cities.txt", "\n".join(PLACE_LINES) + "\n")
    write(f"{scratch}/geo/countryInfo.txt", "#ISO\tCountry\nKE\tKenya\nNA\tNamibia\nUG\tUganda\n")
    common = ["--articles", f"{scratch}/arts", "--places", f"{scratch}/geo/cities.txt",
              "--countries", f"{scratch}/geo/countryInfo.txt"]
    batch = run(spark, parse_args(common + ["--out", f"{scratch}/out1"]))
    assert (batch["articles_processed"], batch["articles_with_match"], batch["total_matches"]) == (5, 3, 3)
    chunked = run(spark, parse_args(common + ["--out", f"{scratch}/out2", "--chunk", "2"]))
    assert (chunked["articles_processed"], chunked["total_matches"], len(chunked["outputs"])) == (5, 3, 3)
    sliced = run(spark, parse_args(common + ["--out", f"{scratch}/out3", "--slice", "1:2"]))   # x1, x2
    assert (sliced["articles_processed"], sliced["total_matches"]) == (2, 0)
    assert (sliced["articles_total"], sliced["percent_complete"]) == (5, 40.0)
    numbered = run(spark, parse_args(common + ["--out", f"{scratch}/out4", "--index"]))
    assert numbered["total_matches"] == 3
    rows = spark.read.option("header", True).csv(numbered["outputs"]).collect()
    assert sorted(int(r["index"]) for r in rows) == [0, 1, 2]
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: int(r["index"]))] == sorted(r["doc_id"] for r in rows)


def test_countries_reader_short_lines(spark, scratch):
    write(f"{scratch}/geo/c.txt", "ISO\tISO3\tCountry\tCapital\nKE\tKEN\tKenya\nUG\tUGA\tUganda\tKampala\n")
    rows = sorted((r.iso, r.country, r.Capital) for r in read_countries(spark, f"{scratch}/geo/c.txt").collect())
    assert rows == [("KE", "Kenya", None), ("UG", "Uganda", "Kampala")]


def test_article_docs_nested_tags(spark, scratch):
    write(f"{scratch}/arts/a.nxml", "<article><front><journal-title>J</journal-title></front>"
                                    "<body><sec>Kenya <sec>Nairobi</sec></sec></body></article>")
    rows = article_docs(read_articles(spark, f"{scratch}/arts"), tag="sec").collect()
    assert [(r.text, r.journal) for r in rows] == [("Kenya Nairobi\n\nNairobi\n\n", "J")]


def test_stream_resume_skips_committed_chunks(spark, scratch):
    make_corpus(f"{scratch}/arts")
    gaz = gazetteer(spark)
    first = run_chunked(spark, f"{scratch}/arts", gaz, f"{scratch}/out", files_per_chunk=2, run_id="r1")
    assert first.articles_processed == 5
    write(f"{scratch}/arts/new/x9.nxml", ARTICLE.format(i=9, text="Kenya: Nairobi"))
    again = run_chunked(spark, f"{scratch}/arts", gaz, f"{scratch}/out", files_per_chunk=2, run_id="r1")
    assert [c.rpartition("/")[2] for c in again.new_chunks] == ["chunk=4"]
    # totals cover the whole run, the chunks of the first call included
    assert (again.articles_processed, again.total_matches) == (6, first.total_matches + 1)
    assert len(again.chunks) == 4 and again.percent_complete == 100.0
    finished = run_chunked(spark, f"{scratch}/arts", gaz, f"{scratch}/out", files_per_chunk=2, run_id="r1")
    assert finished.new_chunks == [] and finished.articles_processed == 6


def test_stream_takes_files_of_any_age(spark, scratch):
    make_corpus(f"{scratch}/arts")
    gaz = gazetteer(spark)
    run_chunked(spark, f"{scratch}/arts", gaz, f"{scratch}/out", run_id="old")
    write(f"{scratch}/arts/new/x9.nxml", ARTICLE.format(i=9, text="Kenya: Nairobi"))
    os.utime(f"{scratch}/arts/new/x9.nxml", (1e9, 1e9))
    again = run_chunked(spark, f"{scratch}/arts", gaz, f"{scratch}/out", run_id="old")
    assert again.articles_processed == 6 and len(again.new_chunks) == 1


def test_a_run_id_belongs_to_one_input_and_output(spark, scratch):
    make_corpus(f"{scratch}/arts")
    make_corpus(f"{scratch}/arts2")
    gaz = gazetteer(spark)
    run_chunked(spark, f"{scratch}/arts", gaz, f"{scratch}/out", run_id="mine")
    for root, out in (("arts", "out2"), ("arts2", "out")):
        with pytest.raises(ValueError):
            run_chunked(spark, f"{scratch}/{root}", gaz, f"{scratch}/{out}", run_id="mine")


def test_totals_with_line_breaks_and_quotes(spark, scratch):
    from toponymic.plans.run import parse_args, run
    odd = ARTICLE.replace("J{i}", ' "J{i}",\nnew line ')
    for i, text in enumerate(TEXTS[:2]):
        write(f"{scratch}/arts/x{i}.nxml", odd.format(i=i, text=text))
    write(f"{scratch}/geo/cities.txt", "\n".join(PLACE_LINES) + "\n")
    write(f"{scratch}/geo/countryInfo.txt", "#ISO\tCountry\nKE\tKenya\nNA\tNamibia\nUG\tUganda\n")
    common = ["--articles", f"{scratch}/arts", "--places", f"{scratch}/geo/cities.txt",
              "--countries", f"{scratch}/geo/countryInfo.txt"]
    for i, extra in enumerate(([], ["--chunk", "1"])):
        t = run(spark, parse_args(common + ["--out", f"{scratch}/out{i}", *extra]))
        assert (t["articles_total"], t["articles_processed"], t["articles_with_match"], t["total_matches"]) == (2, 2, 1, 1)
        assert t["percent_complete"] == 100.0
        schema = "doc_id string, geonameid long, name string, asciiname string, latitude double, longitude double, " \
                 "population long, year int, pub_type string, journal string, doi string, pmid string, row_index long"
        rows = [r for p in t["outputs"] for r in read_csv(spark, p, schema).collect()]
        assert [(r.journal, r.name) for r in rows] == [(' "J0",\nnew line ', "Nairobi")]
