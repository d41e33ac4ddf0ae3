"""Every registered query against its SQL oracle (DuckDB) on the smallest driver tables."""

import math
import os

import duckdb
import pytest

from toponymic.plans.queries import ORACLES, QUERIES
from toponymic.sources.fixture import DRIVER_TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    norm = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert canon(df.columns, df.collect()) == canon(ocols, cur.fetchall())


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["doc_id", "row_index", "geonameid", "name", "countrycode"]
    assert df.count() >= 0
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", ["country_gate", "conversation_place_match", "candidate_place_match", "ngram_match"])
def test_literal_bound_changes_no_row(spark, monkeypatch, name):
    import toponymic.operators.match as m
    import toponymic.operators.names as n
    import toponymic.plans.queries as q
    want = canon(QUERIES[name](spark, SF).columns, QUERIES[name](spark, SF).collect())
    monkeypatch.setattr(q, "_INPUTS", {})
    monkeypatch.setattr(m, "MAX_LITERAL_NAMES", 1)
    monkeypatch.setattr(n, "MAX_LITERAL_NAMES", 1)
    df = QUERIES[name](spark, SF)
    assert canon(df.columns, df.collect()) == want


@pytest.mark.parametrize("name", ["place_match", "country_gate", "candidate_place_match", "ngram_match", "conversation_place_match"])
def test_broadcast_bound_changes_no_row_and_shuffles_no_text(spark, monkeypatch, name):
    import re

    import toponymic.operators.names as n
    import toponymic.plans.queries as q
    want = canon(QUERIES[name](spark, SF).columns, QUERIES[name](spark, SF).collect())
    monkeypatch.setattr(q, "_INPUTS", {})
    monkeypatch.setattr(n, "MAX_BROADCAST_BYTES", 0)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES[name](spark, SF)
        assert canon(df.columns, df.collect()) == want
        plan = df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # no row that an explode made carries a text, a word array or a token array into a join
    for line in plan.split("\n"):
        m = re.search(r"Generate explode.*?, \[(.*?)\]", line)
        if m:
            assert "Generate" in line
    exploded = re.findall(r"Project \[([^\]]*__tok#[^\]]*)\]", plan)
    assert all(not re.search(r"\b(text|words|toks)#", p) for p in exploded)
