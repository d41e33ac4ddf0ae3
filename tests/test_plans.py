"""Plan properties the design relies on (what the optimizer must not undo)."""

import os
import re

import pytest

from toponymic.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def plan_of(spark, name):
    df = QUERIES[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def corpus_side(plan: str) -> str:
    """Lines of the plan above the documents scan that are not on the gazetteer side."""
    return "\n".join(line for line in plan.split("\n")
                     if "InMemory" not in line and "benchmark" not in line)


@pytest.mark.parametrize("name", ["place_match", "match_export", "candidate_place_match",
                                  "entity_place_match", "ngram_match", "token_exact_match"])
def test_match_is_a_broadcast_hash_join(spark, name):
    plan = plan_of(spark, name)
    assert "BroadcastHashJoin" in plan
    assert "SortMergeJoin" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name, columns", [("place_match", "doc_id,text"),
                                           ("np_candidates", "doc_id,text"),
                                           ("match_export", "doc_id,text,lang,source")])
def test_only_needed_columns_are_read(spark, name, columns):
    plan = plan_of(spark, name)
    scans = re.findall(r"FileScan parquet \[([^\]]*)\][^\n]*documents\.parquet", plan)
    assert scans and all(re.sub(r"#\d+L?", "", s) == columns for s in scans)


@pytest.mark.parametrize("name", ["place_match", "np_candidates", "candidate_place_match", "ngram_match"])
def test_no_shuffle_of_the_corpus_beyond_small_input_spread(spark, name):
    plan = plan_of(spark, name)
    shuffles = re.findall(r"Exchange (\w+)\(([^)]*)\)[^\n]*", corpus_side(plan))
    # the only corpus-side exchange is the spread of a one-split input (REPARTITION_BY_NUM)
    corpus = [s for s in re.findall(r"Exchange [^\n]*", corpus_side(plan)) if "REPARTITION_BY_NUM" not in s
              and "doc_id" in s]
    assert corpus == [], shuffles


def test_tag_test_stays_on_the_gazetteer_side(spark):
    plan = plan_of(spark, "token_exact_match")
    token_side = plan.split("BroadcastExchange")[0]
    assert "RLIKE" not in token_side


@pytest.mark.parametrize("name, array", [("place_match", "words"), ("candidate_place_match", "spans"), ("ngram_match", "toks")])
def test_the_gate_comes_before_the_explode(spark, name, array):
    """Units without a country lose their array in the generator's input, and texts are tokenized once."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    generators = re.findall(r"Generate (?:pos)?explode\((.*?)\), ", plan)
    assert any("size(isos" in g or "CASE WHEN" in g for g in generators) or re.search(r"CASE WHEN \(size\(isos", plan)
    text = re.search(r"\(text#(\d+)|\btext#(\d+)", next(x for x in reversed(plan.split("\n")) if "doc_id#" in x and "Relation" in x))
    ident = text.group(1) or text.group(2)
    assert len(re.findall(rf"regexp_extract_all\(text#{ident}\b", plan)) <= (2 if name == "ngram_match" else 1)


def test_a_live_session_keeps_its_settings(spark):
    from toponymic.session import get_session
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert get_session(shuffle_partitions=77) is not None
        assert spark.conf.get("spark.sql.session.timeZone") == "America/New_York"
        assert spark.conf.get("spark.sql.shuffle.partitions") != "77"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
