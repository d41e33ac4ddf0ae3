"""Entities from a phrase list against a plain longest-match loop."""

import random
import re

import pytest

import toponymic.operators.names as names
from toponymic.operators.candidates import candidates_long, token_arrays
from toponymic.operators.match import Gazetteer
from toponymic.operators.phrase_entities import phrase_docs
from toponymic.plans.jobs import match_corpus

TOKEN = r"[^\W]+|[^\w\s]"


def plain(text, phrases):
    """Phrases found from the left, the longest first."""
    listed = {tuple(re.findall(TOKEN, re.sub("[()]", "", p))) for p in phrases if p} - {()}
    tok, at, out = re.findall(TOKEN, re.sub("[()]", "", text or "")), 0, []
    while at < len(tok):
        n = max((len(p) for p in listed if tuple(tok[at:at + len(p)]) == p), default=0)
        if n:
            out.append((at, "".join(t + " " for t in tok[at:at + n])))
        at += n or 1
    return out


def found(spark, texts, phrases):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    table = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    got = {}
    for r in candidates_long(phrase_docs(token_arrays(docs), table)).collect():
        got.setdefault(r["doc_id"], []).append((r["cand_id"], r["phrase"]))
    return {k: sorted(v) for k, v in got.items()}


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_plain_loop(spark, monkeypatch, seed, broadcast):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "c", "San", "of", "Élan", "x."])
    phrases = [" ".join(word() for _ in range(rng.choice([1, 2, 2, 3, 3, 5, 8]))) for _ in range(25)]
    phrases += [None, "", " () ", phrases[0], "(a) (b)"]
    texts = [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(40)] + [None, "", "a " * 3000, "San"]
    if not broadcast:
        monkeypatch.setattr(names, "MAX_BROADCAST_BYTES", 0)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = found(spark, texts, phrases)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {i: plain(t, phrases) for i, t in enumerate(texts)}
    assert got == {i: w for i, w in want.items() if w}
    assert any(p.count(" ") > 2 for w in want.values() for _, p in w)


def test_empty_list_and_table(spark):
    assert found(spark, ["a b"], []) == {} and found(spark, [], ["a"]) == {}


def test_longest_wins_and_neighbours_stay_apart(spark):
    got = found(spark, ["New York City New York Rio", "York City Hall"], ["New York", "New York City", "York City Hall", "Rio", "York"])
    assert got == {0: [(0, "New York City "), (3, "New York "), (5, "Rio ")], 1: [(0, "York City Hall ")]}


def test_job_with_a_phrase_list(spark):
    docs = spark.createDataFrame([(1, "Aland and San Jose del Monte, San Jose", "en"), (2, "San Jose", "es")],
                                 "doc_id long, text string, lang string")
    places = spark.createDataFrame([(0, 10, "San Jose", "San Jose", 0.0, 0.0, 5, "AL")],
                                   "row_index long, geonameid long, name string, asciiname string, latitude double, "
                                   "longitude double, population long, countrycode string")
    gaz = Gazetteer(places, spark.createDataFrame([("AL", "Aland")], "iso string, country string"))
    phrases = spark.createDataFrame([("San Jose",), ("San Jose del Monte",), ("Aland",)], "phrase string")
    rows = match_corpus(docs, gaz, on="entities", phrases=phrases, keep=("lang",)).collect()
    assert sorted((r["doc_id"], r["cand_id"], r["name"], r["lang"]) for r in rows) == [
        (1, 2, "San Jose", "en"), (1, 7, "San Jose", "en")]         # document 2 names no country
    with pytest.raises(ValueError):
        match_corpus(docs, gaz, on="noun_phrases", phrases=phrases)


def test_a_position_takes_the_tokens_that_follow_only_where_a_phrase_starts(spark):
    """Slices of the text's tokens are made above the join with the first tokens, not for every token."""
    table = spark.createDataFrame([("San Jose",), ("Rio",)], "phrase string")
    docs = spark.createDataFrame([(1, "San Jose (and) Rio")], "doc_id long, text string")
    plan = phrase_docs(token_arrays(docs), table)._jdf.queryExecution().optimizedPlan().toString()
    slices = [i for i, line in enumerate(plan.splitlines()) if "slice(tokens" in line]
    generated = [i for i, line in enumerate(plan.splitlines()) if "Generate posexplode" in line]
    joined = [i for i, line in enumerate(plan.splitlines()) if "Join Inner" in line]
    assert slices and generated and joined and max(slices) < min(joined) < min(generated)
    assert "translate(" not in plan
