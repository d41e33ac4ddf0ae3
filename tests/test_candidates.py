"""Tokens, tags and candidate phrases: FIXTURES cases 18-23 and the equivalence of the
in-row chunker with window islands over a supplied tag table."""

import random

import pytest
from pyspark.sql import functions as F

from fixtures import docs_df, gazetteer
from toponymic.functions.text import NP_SPAN, ENTITY_SPAN, chunk
from toponymic.operators.candidates import (candidate_docs, candidates_from_tagged, candidates_long, tagged_docs, token_arrays,
                                            tokens_long)
from toponymic.operators.tokens import exact_token_matches, noun_names
from toponymic.plans.jobs import match_corpus


def chunks_for_tags(spark, tags, kind="noun_phrases"):
    """Phrases (start, end) for a tag sequence, via a lexicon that forces each tag."""
    words = [f"w{i}" for i in range(len(tags))]
    lex = {w: t for w, t in zip(words, tags)}
    docs = docs_df(spark, [" ".join(words)])
    rows = candidates_long(candidate_docs(token_arrays(docs), kind, lexicon=lex)).collect()
    return sorted((r.cand_id, r.cand_id + len(r.phrase.split()) - 1) for r in rows)


@pytest.mark.parametrize("tags, expected", [
    (["JJ", "JJ", "NN", "NNS", "VB"], [(0, 3)]),          # 18
    (["NN", "JJ", "NNP"], [(0, 0), (1, 2)]),              # 19
    (["JJ", "VB", "NN", "JJ"], [(2, 2)]),                 # 20 trailing adjective dropped
    (["JJR", "NN"], [(1, 1)]),                            # 21 JJ exact
])
def test_noun_phrase_cases(spark, tags, expected):
    assert chunks_for_tags(spark, tags) == expected


def test_phrase_text_and_parens(spark):
    docs = docs_df(spark, ["Big (Nairobi) town"])
    rows = candidates_long(candidate_docs(token_arrays(docs), "entities")).collect()
    assert [(r.cand_id, r.phrase) for r in rows] == [(0, "Big Nairobi ")]


def test_candidate_bag(spark):                                           # 22
    gaz = gazetteer(spark, places=[(0, "Nairobi", "KE")], countries=[("KE", "Kenya")])
    docs = docs_df(spark, ["Kenya is big. Nairobi is hot; Nairobi area"])
    rows = match_corpus(docs, gaz, on="noun_phrases").collect()
    # "Kenya" (0) opens the gate; both phrases holding Nairobi report row 0 (bag)
    assert sorted((r.cand_id, r.row_index) for r in rows) == [(4, 0), (8, 0)]
    once = match_corpus(docs, gaz, on="noun_phrases", distinct=True).collect()
    assert [(r.doc_id, r.row_index) for r in once] == [(0, 0)]


def test_exact_token_match(spark):                                       # 23
    from fixtures import places_df
    docs = docs_df(spark, ["Nairobi sees Nairobi"])
    rows = exact_token_matches(docs, noun_names(places_df(spark))).orderBy("pos").collect()
    assert [(r.pos, r.token) for r in rows] == [(0, "Nairobi"), (2, "Nairobi")]


def test_tokens_and_tags(spark):
    docs = docs_df(spark, ["The big (Nairobi) 42 flows, quickly sing."])
    rows = tokens_long(token_arrays(docs)).orderBy("pos").collect()
    assert [(r.token, r.tag) for r in rows] == [
        ("The", "DT"), ("big", "NN"), ("Nairobi", "NNP"), ("42", "CD"), ("flows", "NNS"), (",", "."),
        ("quickly", "RB"), ("sing", "VBG"), (".", ".")]


@pytest.mark.parametrize("kind", ["noun_phrases", "entities"])
def test_inrow_chunker_equals_window_islands(spark, kind):
    rnd = random.Random(11)
    tagset = ["JJ", "JJR", "NN", "NNS", "NNP", "VB", "DT", "."]
    seqs = [[rnd.choice(tagset) for _ in range(rnd.randint(0, 25))] for _ in range(150)]
    long_rows, docs = [], []
    for d, seq in enumerate(seqs):
        for p, t in enumerate(seq):
            long_rows.append((d, p, f"t{p}", t))
    tagged = spark.createDataFrame(long_rows, "doc_id long, pos long, token string, tag string")
    # the same sequences through the in-row path: arrays rebuilt per document
    arrays = (tagged.groupBy("doc_id")
                    .agg(F.array_sort(F.collect_list(F.struct("pos", "token", "tag"))).alias("z"))
                    .select("doc_id", F.transform("z", lambda x: x["token"]).alias("tokens"),
                            F.transform("z", lambda x: x["tag"]).alias("tags")))
    pattern = NP_SPAN if kind == "noun_phrases" else ENTITY_SPAN
    tag_map = F.map_from_arrays(F.col("tokens"), F.col("tags"))
    inrow = (arrays.select("doc_id", F.explode(chunk(F.col("tokens"), pattern, tag_map)).alias("c"))
                   .select("doc_id", "c.cand_id", "c.phrase"))
    islands = candidates_from_tagged(tagged, kind)
    a = sorted(map(tuple, inrow.collect()))
    b = sorted(map(tuple, islands.collect()))
    assert a == b and len(a) > 50


def test_supplied_tags_path_equals_in_row_path(spark):
    texts = ["Kenya is big. Nairobi is hot; Nairobi area", "Uganda: Fort Portal town (Kampala) and Kenya Mombasa",
             "St. John Kenya", "", "Kampala Nairobi"]
    docs = docs_df(spark, texts)
    gaz = gazetteer(spark)
    in_row = match_corpus(docs, gaz, on="noun_phrases")
    tagged = tokens_long(token_arrays(docs))                       # (doc_id, pos, token, tag) as if supplied
    units = gaz.phrase_units(candidates_from_tagged(tagged, "noun_phrases"))
    supplied = gaz.places_in(units)                                # gate by join on (doc_id, iso)
    key = lambda r: (r.doc_id, r.cand_id, r.row_index)
    a, b = sorted(map(key, in_row.collect())), sorted(map(key, supplied.collect()))
    assert a == b and len(a) >= 4


def test_chunker_equals_python_greedy_regex(spark):
    import re as _re
    rnd = random.Random(5)
    tagset = ["JJ", "JJS", "NN", "NNS", "NNP", "NNPS", "VB", "IN", "."]
    seqs = [[rnd.choice(tagset) for _ in range(rnd.randint(0, 30))] for _ in range(120)]
    lex, texts = {}, []
    for d, seq in enumerate(seqs):
        words = [f"d{d}w{p}" for p in range(len(seq))]
        lex.update(zip(words, seq))
        texts.append(" ".join(words))
    docs = docs_df(spark, texts)
    rows = candidates_long(candidate_docs(token_arrays(docs), "noun_phrases", lexicon=lex)).collect()
    got = sorted((r.doc_id, r.cand_id, len(r.phrase.split())) for r in rows)
    # reference semantics: <JJ>*<NN.*>+ as a greedy, leftmost, non-overlapping regex
    # over one letter per tag (J = JJ exactly, N = NN*, O = other)
    want = []
    for d, seq in enumerate(seqs):
        letters = "".join("J" if t == "JJ" else "N" if t.startswith("NN") else "O" for t in seq)
        want += [(d, m.start(), m.end() - m.start()) for m in _re.finditer("J*N+", letters)]
    assert got == sorted(want) and len(want) > 100


def test_candidates_with_join_gate_equal_in_row_gate(spark, monkeypatch):
    texts = ["Kenya is big. Nairobi is hot; Nairobi area", "Uganda: Fort Portal town (Kampala) and Kenya Mombasa",
             "Big Windhoek Namibia", "Kampala Nairobi", ""]
    docs = docs_df(spark, texts)
    key = lambda r: (r.doc_id, r.cand_id, r.row_index)
    in_row = sorted(map(key, match_corpus(docs, gazetteer(spark), on="noun_phrases").collect()))
    import toponymic.operators.match as m
    monkeypatch.setattr(m, "MAX_LITERAL_NAMES", 1)          # country list no longer inlined
    gaz = gazetteer(spark)
    assert gaz.lookup is None
    joined = sorted(map(key, match_corpus(docs, gaz, on="noun_phrases").collect()))
    assert joined == in_row and len(in_row) >= 4


def test_lexicon_of_any_size(spark):
    """50,000 entries take the join path and give what a literal lexicon gives."""
    from toponymic.operators.candidates import candidate_docs, candidates_long, token_arrays, tokens_long
    from toponymic.plans.jobs import match_corpus
    docs = docs_df(spark, ["Kenya: the zebra town Nairobi area. Runs", "Uganda fort zebra", ""]).withColumn("journal", F.lit("j"))
    small = [("zebra", "JJ"), ("zebra", "VB"), ("Runs", "VB"), (None, "NN")]
    big = small + [(f"x{i}", "VB") for i in range(50_000)]
    schema = "token string, tag string"
    lex, large = spark.createDataFrame(small, schema), spark.createDataFrame(big, schema)
    rows = lambda df: sorted(map(tuple, df.collect()))     # noqa: E731
    tok = token_arrays(docs)
    tags = rows(tokens_long(tok, lexicon=lex))
    assert ("zebra", "JJ") in {(r[2], r[3]) for r in tags}     # the smallest tag of a repeated token
    assert rows(tokens_long(tok, lexicon=large)) == tags
    assert rows(tokens_long(tok, lexicon=dict(large.dropna().collect()))) != []
    gaz = gazetteer(spark)
    for on in ("noun_phrases", "entities"):
        a, b = (match_corpus(docs, gaz, on=on, lexicon=x, keep=("journal",)) for x in (lex, large))
        assert rows(a.select("doc_id", "cand_id", "row_index", "journal")) == rows(b.select("doc_id", "cand_id", "row_index", "journal")) != []
    assert candidates_long(candidate_docs(tok, lexicon=lex)).count() > 0


def test_supplied_tags_end_to_end(spark):
    from toponymic.plans.jobs import match_corpus
    gaz = gazetteer(spark)
    tagged = spark.createDataFrame(
        [(1, 0, "Kenya", "XX", True), (1, 1, "saw", "VB", False), (1, 2, "Nairobi", "XX", True), (2, 0, "Nairobi", "NN", False)],
        "doc_id long, pos int, token string, tag string, place boolean")
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, journal string")
    got = match_corpus(docs, gaz, on="entities", tagged=tagged, entity_col="place", keep=("journal",)).collect()
    assert [(r.doc_id, r.cand_id, r.row_index, r.journal) for r in got] == [(1, 2, 0, "a")]
    assert match_corpus(None, gaz, on="noun_phrases", tagged=tagged).collect() == []
    with pytest.raises(ValueError):
        match_corpus(docs, gaz, on="text", tagged=tagged)


@pytest.mark.parametrize("kind", ["noun_phrases", "entities"])
def test_tagged_docs_equal_window_islands(spark, kind):
    """Sparse positions in any order, tokens of any shape, null tags: the one-exchange form and the islands agree."""
    rnd = random.Random(17)
    tags = ["JJ", "JJR", "NN", "NNS", "NNP", "NNP", "VB", None]
    rows = []
    for d in range(120):
        for p in sorted(rnd.sample(range(10 ** 6), rnd.randint(0, 30))):
            rows.append((None if d == 7 else f"d{d}", p, rnd.choice(["x", "U.S.", "don't", "New York", "P000000012z", "é", ""]),
                         rnd.choice(tags), rnd.random() < 0.4))
    rnd.shuffle(rows)
    tagged = spark.createDataFrame(rows, "doc_id string, pos int, token string, tag string, flag boolean").repartition(5)
    flag = "flag" if kind == "entities" else None
    key = lambda r: (r.doc_id or "", r.cand_id, r.phrase)
    got = sorted(map(key, candidates_long(tagged_docs(tagged, kind, flag)).collect()))
    assert got == sorted(map(key, candidates_from_tagged(tagged, kind, flag).collect())) and len(got) > 100
    assert tagged_docs(tagged.limit(0), kind).count() == 0


def test_supplied_tags_gate_before_the_explode(spark):
    """Tokens that hold several word runs; countries in other phrases of the document; one exchange of the tokens."""
    gaz = gazetteer(spark)
    rows = [(1, 0, "St. John's Kenya", "NNP"), (1, 5, "is", "VB"), (1, 9, "Nairobi", "NNP"), (1, 12, "Nairobi\nNairobi", "NN"),
            (2, 0, "Nairobi", "NNP"), (3, 3, "Uganda", "NN"), (3, 4, "Kampala", "NN"), (3, 1, "Fort", "NN"), (3, 2, "Portal", "NN"),
            (3, None, "Kampala", "NN"), (4, 0, None, "NN")]
    tagged = spark.createDataFrame(rows, "doc_id long, pos long, token string, tag string")
    got = match_corpus(None, gaz, on="noun_phrases", tagged=tagged)
    units = gaz.phrase_units(candidates_from_tagged(tagged.where("pos IS NOT NULL"), "noun_phrases"))
    key = lambda r: (r.doc_id, r.cand_id, r.row_index)
    assert sorted(map(key, got.collect())) == sorted(map(key, gaz.places_in(units).collect()))
    assert {r.doc_id for r in got.collect()} == {1, 3}
    plan = match_corpus(None, gaz, on="noun_phrases", tagged=tagged)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ObjectHashAggregate") == 2 and "SortMergeJoin" not in plan and "Window" not in plan


def test_positions_out_of_range_stop_the_job(spark):
    tagged = spark.createDataFrame([(1, 10 ** 9, "Kenya", "NN")], "doc_id long, pos long, token string, tag string")
    with pytest.raises(Exception, match="digits at most"):
        tagged_docs(tagged).collect()


def test_coded_units_hold_only_tokens_of_phrases(spark):
    """Tokens outside of any phrase are a letter alone; classes are those of the tags, whatever a token begins with."""
    from toponymic.functions.text import class_rule, coded_units, tag_class, tag_rule
    tokens = ["The", "the", "tHIS", "that", "fatal", "Fatal", "ing", "sing", "42", "4x", "x4", "_a", "é", "Élan", "élan", "İ", "ﬀ", "{", "~",
              "`", "with", "within", "a", "z", "A", "from", "FROM", "quickly", "used", "nous", "٣", "ⅷ", "", "𐐀x", "K"]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    t = F.col("t")
    assert df.where(~class_rule(t).eqNullSafe(tag_class(tag_rule(t)))).collect() == []
    got = token_arrays(docs_df(spark, ["the big (Nairobi) sings"])).select(coded_units(F.col("tokens")).alias("c")).first().c
    assert got == "\nO\nN000000001big\nP000000002Nairobi\nN000000003sings"
