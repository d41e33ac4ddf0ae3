import random
import re
from collections import Counter

import numpy as np
import pytest

from toponymic.llm import quality, queries, texts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __votes int, quality double, __qn_words int"
WORDS = "alpha beta gamma delta house river mountain people walking under bright yellow stars while singing old songs".split()


def row(i, text):
    return (i, text, "en", "s", len(text or ""), 1, 0.5, 2)


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered.update(range(i, i + 5))
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered), len(lines)]


def corpus(rng, n=300):
    rows = []
    for i in range(n):
        words = [rng.choice(WORDS) + rng.choice(["", "ed", "s", "ing"]) for _ in range(rng.randint(30, 120))]
        kind = i % 10
        if kind == 0:
            text = " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in words)
        elif kind == 1:
            text = "\n".join([" ".join(w.upper() + "!!" for w in words[:20])] * 5)
        elif kind == 2:
            text = " | ".join(words)
        else:
            text = " ".join(words)
        rows.append((row(i, text), kind > 2))
    return rows


CASES = ["", " \n\t", "a", "a b c d e a b c d e", "x\nx\n \nx", "é " * 30, "#$%&|<>*# a", "a b c d\na b c d\na b c d", "one two\x0bthree\x85four",
         "a b c d e f a b c d e f a b c d e", "A!! B!!", "𝄞 日本 " * 7]


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_counts_against_plain_python(monkeypatch, most):
    monkeypatch.setattr(texts, "CHUNK_BYTES", most)
    rng = random.Random(2)
    cases = CASES + [" ".join(rng.choices("abc", k=rng.randint(0, 60))) + rng.choice(["", "\n", "\n\nb"]) for _ in range(200)]
    got = quality.counts([c.encode() for c in cases])
    for c, g in zip(cases, got):
        assert g[:6].tolist() == plain_counts(c), c


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20000) < 0.85
    votes = np.zeros((20000, 5), dtype=np.int64)
    for j, (hit, false) in enumerate([(0.5, 0.01), (0.4, 0.02), (0.6, 0.01), (0.3, 0.0), (0.5, 0.03)]):
        bad_vote = rng.random(20000) < np.where(good, false, hit)
        votes[:, j] = np.where(bad_vote, -1, np.where(rng.random(20000) < 0.7, 1, 0))
    patterns, inverse, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p = quality.fit(patterns, n.astype(float))[inverse.ravel()]
    assert ((p >= 0.5) == good).mean() > 0.95
    assert abs(p.mean() - 0.85) < 0.03


def test_verdicts(spark):
    rows = corpus(random.Random(1))
    df = spark.createDataFrame([r for r, _ in rows], SCHEMA).select("doc_id", "text")
    got = {r["doc_id"]: r["good"] for r in quality.quality(df).collect()}
    assert got == {r[0]: good for r, good in rows}


def test_stage_keeps_columns_rows_and_repeats(spark):
    rows = corpus(random.Random(1))
    extra = [row(900, None), row(901, ""), row(None, rows[5][0][1]), rows[6][0], row(902, "too short")]
    df = spark.createDataFrame([r for r, _ in rows] + extra, SCHEMA)
    got = quality.good_documents(df)
    assert got.columns == df.columns and got.schema == df.schema
    want = [r for r, good in rows if good] + [extra[2], extra[3]]
    key = lambda r: (r[0] is None, *map(str, r))     # noqa: E731
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert quality.good_documents(df).collect() == []
    assert quality.quality(df.select("doc_id", "text")).collect() == []


def test_query_columns(spark, tmp_path):
    rows = [r for r, _ in corpus(random.Random(4), 60)] + [row(500 + i, c) for i, c in enumerate([*CASES, None])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op4_quality(spark, str(tmp_path)).collect()}
    for r in rows:
        n, chars, symbols, dup, repeated, _ = plain_counts(r[1] or "")
        g = got[r[0]]
        failed = n < 10 or 100 * repeated > 20 * n
        assert [g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"], g["base_failed"]] == [
            n, chars, symbols, dup, repeated, failed]
        assert not (failed and g["kept"])
