"""Every stage against a plain version of it, on its own input."""

import os
import random
import re

import pytest

import corpus_pipeline as pipeline
from toponymic.llm import langid, pii, queries, simhash
from toponymic.llm import quality as q

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [(None, "no id but ten words of text that are kept here", "en", "s", 1), (9001, None, None, None, None), (9002, "", "en", None, 0),
        (9003, "word " * 20000, "en", "s", None)]


@pytest.fixture(scope="module")
def docs(spark):
    if not os.path.isdir(SF):
        pytest.skip("driver tables not present")
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df.unionByName(spark.createDataFrame(EDGE + [tuple(df.first())], SCHEMA))


def plain_links(texts):
    values = [int(v) for v in simhash.simhashes([(t or "").encode() for t in texts])]
    group = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 2:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return group


def test_stages(spark, docs):
    before = docs.collect()
    rows = pipeline.quality_rules(spark, docs, SF)
    assert rows.columns == COLUMNS
    verdict = {(r["doc_id"]): r["good"] and not (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
               for r in q.quality(docs).collect()}
    good = rows.collect()
    assert sorted(map(str, good)) == sorted(str(r) for r in before if verdict[r["doc_id"]])

    rows = pipeline.known_languages(spark, spark.createDataFrame(good, SCHEMA), SF)
    assert rows.columns == COLUMNS
    spoken = rows.collect()
    profiles = langid.train(spark.createDataFrame(good, SCHEMA))
    found = profiles.predict([r["text"] or "" for r in good])
    assert sorted(map(str, spoken)) == sorted(str(r) for r, (lang, s) in zip(good, found) if lang != "und" and s >= langid.LEAST)

    rows = pipeline.simhash_dedup(spark, spark.createDataFrame(spoken, SCHEMA), SF)
    assert rows.columns == COLUMNS
    single = rows.collect()
    groups = plain_links([r["text"] for r in spoken])
    assert len(single) == len(set(groups)) < len(spoken)
    assert sorted(groups[spoken.index(r)] for r in single) == sorted(set(groups))

    rows = pipeline.surrogates(spark, spark.createDataFrame(single, SCHEMA), SF)
    assert rows.columns == COLUMNS
    clean = rows.collect()
    assert len(clean) == len(single)
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["lang"] or "")
    for old, new in zip(sorted(single, key=key), sorted(clean, key=key)):
        spans = pii.find(old["text"])
        for start, end, _, _ in spans:
            assert old["text"][start:end] not in new["text"]
        if not spans:
            assert old["text"] == new["text"]
        assert new["n_chars"] == len(new["text"])

    packed = pipeline.best_fit(spark, spark.createDataFrame(clean, SCHEMA), SF).collect()
    length = {}
    for r in packed:
        length[r["doc_id"]] = length.get(r["doc_id"], 0) + r["piece_length"]
    assert length == {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in clean}


def test_run_and_empty(spark, tmp_path):
    if not os.path.isdir(SF):
        pytest.skip("driver tables not present")
    assert pipeline.run(spark, SF).count() > 100
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_all_stages_call_one_operator_each_and_all_queries_are_registered():
    assert [n for n, _ in pipeline.STAGES] == ["quality", "language", "simhash", "surrogates", "packing"]
    import __spark_entry__ as entry
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11))
    assert set(queries.QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()


def test_very_unequal_groups(spark):
    """A third of all rows are one text, many others near copies of another."""
    rng = random.Random(0)
    words = [f"w{i}" for i in range(500)]
    base, copy = rng.choices(words, k=200), " ".join(rng.choices(words, k=80))
    rows = [(i, copy, "en", "s", 1) for i in range(300)]
    for i in range(300, 900):
        near = list(base)
        near[i % 200] = "x"
        rows.append((i, " ".join(near), "en", "s", 1))
    kept = pipeline.simhash_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    groups = plain_links([r[1] for r in rows[299:]])
    assert len(kept) == len(set(groups))
