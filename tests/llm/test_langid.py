import random
import zlib
from collections import Counter

import pytest

from toponymic.llm import langid, queries

SCHEMA = "doc_id long, text string, lang string, score string"
SYLLABLES = {"xx": "ka to mi ra ne su lo".split(), "yy": "schr ung keit ber ein ich".split(), "zz": "ção nh lha ões que mente".split()}


def sentence(rng, lang, n=40):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def plain_grams(text):
    """N-grams of one to three letters, a word padded with one blank on each side."""
    out, word = Counter(), ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            padded = f" {word} "
            out.update(word)
            out.update(padded[i:i + 2] for i in range(len(padded) - 1))
            out.update(padded[i:i + 3] for i in range(len(padded) - 2))
            word = ""
    return out


def order(gram):
    """Place of an n-gram among those of equal count: by length, then code points, the boundary first."""
    return len(gram), [1 if c == " " else ord(c) for c in gram]


def plain_profile(counts, size):
    return sorted(counts, key=lambda g: (-counts[g], order(g)))[:size]


def corpus(seed=0, n=150):
    rng = random.Random(seed)
    return [(i, sentence(rng, lang := rng.choice(list(SYLLABLES))), lang, "x") for i in range(n)]


EDGE = ["", None, "123 !!", "ÀÉ ǅ ß", "日本語", "a", "x" * 100000, "İstanbul ΑΣ"]


def test_grams_and_distances_against_plain_python(spark):
    rows = corpus()
    size = 30
    profiles = langid.train(spark.createDataFrame(rows, SCHEMA), size=size)
    total = {}
    for _, text, lang, _ in rows:
        total.setdefault(lang, Counter()).update(plain_grams(text))
    ranked = {lang: plain_profile(c, size) for lang, c in total.items()}
    texts = [r[1] for r in rows] + [x or "" for x in EDGE]
    for text, (lang, score) in zip(texts, profiles.predict(texts)):
        mine = plain_profile(plain_grams(text), size)
        if not mine:
            assert (lang, score) == ("und", 0.0)
            continue
        d = {k: sum(abs(i - p.index(g)) if g in p else size for i, g in enumerate(mine)) for k, p in ranked.items()}
        best = min(sorted(d), key=d.get)
        assert lang == best and score == pytest.approx(1 - d[best] / (len(mine) * size))


def test_held_out_accuracy(spark, tmp_path):
    rows = corpus(1) + [(1000 + i, t, None, None) for i, t in enumerate(EDGE)] + [(None, "ka to mi", "xx", None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op7_language(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for d, text, lang, _ in rows[:150]:
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert got[d]["lang_pred"] == lang and 0 < got[d]["score"] <= 1
    assert [got[1000 + i]["lang_pred"] for i in range(3)] == ["und"] * 3


def test_held_out_rows_teach_nothing(spark, tmp_path):
    rows = corpus(2)
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    wrong = [(d, t, "wrong" if held(d) else lang, x) for d, t, lang, x in rows]
    out = []
    for name, data in (("a", rows), ("b", wrong)):
        spark.createDataFrame(data, SCHEMA).write.parquet(str(tmp_path / name / "documents.parquet"))
        out.append(sorted(map(tuple, queries.op7_language(spark, str(tmp_path / name)).collect())))
    assert out[0] == out[1]


def test_stage(spark):
    rows = corpus(3) + [(1000 + i, t, "xx", None) for i, t in enumerate(EDGE[:3])] + [(2000, "ѣѧѩ ѯѱ ѳѵ", None, None)]
    rows += [rows[0]]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = langid.known_language(df, langid.train(df))
    assert kept.schema == df.schema
    assert sorted(map(str, kept.collect())) == sorted(map(str, [r for r in df.collect() if (r[0] or 0) < 1000]))


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None, None)], SCHEMA)
    assert langid.predict(df, langid.train(df)).collect()[0][1:] == ("und", 0.0)
    none = spark.createDataFrame([], SCHEMA)
    assert langid.predict(none, langid.train(none)).collect() == []
