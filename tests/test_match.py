"""Whole-word, country-gated matching: FIXTURES cases 1-11, plus exactness against the
reference's regex loop on generated text."""

import random
import re

import pytest

from fixtures import docs_df, gazetteer
from toponymic.operators.match import countries_in_text, places_in_text
from toponymic.plans.jobs import match_corpus


def matched(spark, texts, regex_names=False, gate=True):
    gaz = gazetteer(spark, regex_names)
    rows = places_in_text(docs_df(spark, texts), gaz, gate=gate).collect()
    out = {i: [] for i in range(len(texts))}
    for r in rows:
        out[r.doc_id].append(r.row_index)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("text, expected", [
    ("Cases in Nairobi, Kenya.", [0]),                 # 1 country gate drops the UG homonym
    ("Cases in Nairobi.", []),                         # 2 no country, no place
    ("Kenya and Uganda: Nairobi.", [0, 5]),            # 3 homonyms kept
    ("Kenyan traders in Nairobi.", []),                # 4 whole word only
    ("kenya: Nairobi", []),                            # 5 case-sensitive
    ("Uganda: Fort Portal.", [4]),                     # 6 multi-word name
    ("Uganda: Fort and Portal.", []),                  # 6 residual check
    ("Namibia; Windhoek", [2]),                        # 7 code NA stays text
    ("Kenya Nairobi Nairobi Nairobi", [0]),            # 8 yes/no per document
    ("Kenya: St. John", [6]),                          # 9 literal name
    ("Kenya: Stx John", []),                           # 9 literal: '.' is not a wildcard
    ("Kenya: éNairobi", []),                           # 10 Unicode word boundary
    ("", []),                                          # 11 empty
])
def test_fixture_cases(spark, text, expected):
    assert matched(spark, [text])[0] == expected


def test_regex_names(spark):
    got = matched(spark, ["Kenya: St. John", "Kenya: Stx John", "Kenya: StxJohn"], regex_names=True)
    assert got == {0: [6], 1: [6], 2: []}


def test_unanchored_regex_names(spark):
    # a name with a group has no safe anchor: the inlined residual path handles it
    gaz = gazetteer(spark, True, places=[(0, "Nair(o|u)bi", "KE"), (1, "Mombasa", "KE")])
    rows = places_in_text(docs_df(spark, ["Kenya Nairubi", "Kenya Nairobi Mombasa", "Nairobi"]), gaz).collect()
    assert sorted((r.doc_id, r.row_index) for r in rows) == [(0, 0), (1, 0), (1, 1)]


def test_empty_document_is_processed(spark):
    from toponymic.operators.report import doc_match_counts, run_totals
    docs = docs_df(spark, ["", "Kenya Nairobi", None])
    gaz = gazetteer(spark)
    counts = doc_match_counts(docs, places_in_text(docs, gaz))
    assert sorted((r.doc_id, r.n_matches) for r in counts.collect()) == [(0, 0), (1, 1), (2, 0)]
    t = run_totals(counts).collect()[0]
    assert (t.articles_processed, t.articles_with_match, t.total_matches) == (3, 1, 1)


def test_country_match_rows(spark):
    gaz = gazetteer(spark)
    rows = countries_in_text(docs_df(spark, ["Kenya and Uganda", "Namibia Namibia", "none"]), gaz).collect()
    assert sorted((r.doc_id, r.iso) for r in rows) == [(0, "KE"), (0, "UG"), (1, "NA")]


def test_country_table_above_literal_bound_uses_join_gate(spark, monkeypatch):
    import toponymic.operators.match as m
    monkeypatch.setattr(m, "MAX_LITERAL_NAMES", 1)
    texts = ["Cases in Nairobi, Kenya.", "Kenya and Uganda: Nairobi.", "Uganda: Fort Portal.", "Nairobi"]
    gaz = gazetteer(spark)
    assert gaz.lookup is None
    rows = places_in_text(docs_df(spark, texts), gaz).collect()
    assert sorted((r.doc_id, r.row_index) for r in rows) == [(0, 0), (1, 0), (1, 5), (2, 4)]


WORDS = ["Nairobi", "Kenya", "Uganda", "Fort", "Portal", "St", "John", "Kampala", "ab", "x_y", "é", "3"]
SEPS = [" ", ", ", ".", ". ", "-", "_", "", "\n", " (", ") ", "é"]


def reference_matches(texts, countries, places):
    """The reference's loop with escaped (literal) names: countries, then gated places."""
    out = set()
    for d, text in enumerate(texts):
        found = {iso for iso, name in countries if re.search(r"\b" + re.escape(name) + r"\b", text)}
        for row, name, cc in places:
            if cc in found and re.search(r"\b" + re.escape(name) + r"\b", text):
                out.add((d, row))
    return out


def test_anchor_join_equals_regex_loop(spark):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(WORDS) + rnd.choice(SEPS) for _ in range(rnd.randint(0, 30)))
             for _ in range(300)]
    from fixtures import COUNTRIES, PLACES
    places = PLACES + [(7, "Fort-Portal", "UG"), (8, "x_y", "KE"), (9, "John.", "KE"), (10, ".Kampala", "UG"),
                       (11, "3", "NA"), (12, "ab ab", "KE")]
    gaz = gazetteer(spark, places=places)
    got = {(r.doc_id, r.row_index) for r in places_in_text(docs_df(spark, texts), gaz).collect()}
    assert got == reference_matches(texts, COUNTRIES, places)


def test_match_corpus_keeps_metadata(spark):
    docs = spark.createDataFrame([(1, "Kenya Nairobi", "J1")], "doc_id long, text string, journal string")
    rows = match_corpus(docs, gazetteer(spark), keep=("journal",)).collect()
    assert [(r.doc_id, r.journal, r.row_index) for r in rows] == [(1, "J1", 0)]


def test_unanchored_names_above_bound_use_theta_join(spark, monkeypatch):
    import toponymic.operators.match as m
    monkeypatch.setattr(m, "MAX_LITERAL_NAMES", 0)   # nothing may be inlined
    # no three characters that every match holds, so there is no trigram to join on
    gaz = gazetteer(spark, True, places=[(0, "N(airo|airu)bi", "KE"), (1, "Mombasa", "KE")])
    assert gaz.lookup is None and gaz._places.residual_rows is None
    rows = places_in_text(docs_df(spark, ["Kenya Nairubi", "Kenya Nairobi Mombasa", "Nairobi"]), gaz).collect()
    assert sorted((r.doc_id, r.row_index) for r in rows) == [(0, 0), (1, 0), (1, 1)]


def test_gate_counts_single_pass(spark):
    gaz = gazetteer(spark)
    docs = docs_df(spark, ["Cases in Nairobi, Kenya.", "Nairobi", "Kenya and Uganda: Nairobi, Kampala", ""])
    rows = {r.doc_id: (r.n_admitted, r.n_ungated, r.n_gated) for r in gaz.gate_counts(gaz.text_units(docs)).collect()}
    # Kenya admits 3 rows (0, 1, 6); Uganda 3 (3, 4, 5)
    assert rows == {0: (3, 2, 1), 1: (0, 2, 0), 2: (6, 3, 3), 3: (0, 0, 0)}


@pytest.mark.parametrize("max_bytes, anchors_shipped", [(200, True), (1, False)])
def test_index_above_broadcast_bound(spark, monkeypatch, max_bytes, anchors_shipped):
    import toponymic.operators.names as n
    monkeypatch.setattr(n, "MAX_BROADCAST_BYTES", max_bytes)
    texts = ["Cases in Nairobi, Kenya.", "Kenya and Uganda: Nairobi.", "Uganda: Fort Portal.", "Nairobi", ""]
    gaz = gazetteer(spark)
    idx = gaz._places
    assert not idx.broadcast and (idx.anchor_set is not None) == anchors_shipped
    rows = places_in_text(docs_df(spark, texts), gaz).collect()
    assert sorted((r.doc_id, r.row_index) for r in rows) == [(0, 0), (1, 0), (1, 5), (2, 4)]


def test_name_without_word_characters(spark):
    # no word run to anchor on: the inlined residual path applies Python's \b rules
    # (a boundary before '-' needs a word character before it)
    gaz = gazetteer(spark, places=[(0, "---", "KE"), (1, "Nairobi", "KE")])
    rows = places_in_text(docs_df(spark, ["Kenya a---b Nairobi", "Kenya a --- b"]), gaz).collect()
    assert sorted((r.doc_id, r.row_index) for r in rows) == [(0, 0), (0, 1)]
    import re as _re
    assert _re.search(r"\b---\b", "Kenya a---b Nairobi") and not _re.search(r"\b---\b", "Kenya a --- b")


def test_regex_names_equal_unescaped_regex_loop(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice(WORDS) + rnd.choice(SEPS) for _ in range(rnd.randint(0, 25)))
             for _ in range(300)]
    from fixtures import COUNTRIES
    # names used as patterns: dots (safe anchors elsewhere), groups and classes (no anchor)
    places = [(0, "Nair.bi", "KE"), (1, "St. John", "KE"), (2, "Fort.Portal", "UG"), (3, "K(a|e)mpala", "UG"),
              (4, "Kam[p]ala", "UG"), (5, "Nairobi", "UG"), (6, "ab.", "KE"), (7, ".Kenya", "KE")]
    gaz = gazetteer(spark, True, places=places)
    got = {(r.doc_id, r.row_index) for r in places_in_text(docs_df(spark, texts), gaz).collect()}
    want = set()
    for d, text in enumerate(texts):
        found = {iso for iso, name in COUNTRIES if re.search(r"\b" + name + r"\b", text)}
        for row, name, cc in places:
            if cc in found and re.search(r"\b" + name + r"\b", text):
                want.add((d, row))
    assert got == want and len(want) > 20


def test_fallback_tells_units_of_one_key_apart(spark, monkeypatch):
    """Rows that share a doc_id, rows that repeat and null ids: the shuffle join gives the broadcast join's bag."""
    import toponymic.operators.names as n
    rows = [(1, "Uganda: Fort Portal."), (1, "Uganda: Fort and Portal."), (1, "Uganda: Fort Portal."), (None, "Uganda: Fort Portal."),
            (None, "Kenya: St. John Nairobi"), (2, "Fort Portal"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lambda: sorted(map(str, places_in_text(docs, gazetteer(spark)).select("doc_id", "row_index").collect()))
    want = found()
    assert len(want) == 5
    monkeypatch.setattr(n, "MAX_BROADCAST_BYTES", 0)
    assert found() == want
