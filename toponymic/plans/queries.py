"""Named queries over the driver tables, each with its SQL oracle (DuckDB dialect).

Every query reads whole tables: the full corpus (``documents`` or ``pages``) and the
gazetteer derived from ``benchmark`` (``sources.fixture``). Index preparation is shared
per session and data folder, so several queries do not rebuild it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toponymic.functions import markup
from toponymic.functions import text as textf
from toponymic.functions.words import whole_word
from toponymic.operators import report
from toponymic.operators.article_markup import with_article_fields, with_tag_text
from toponymic.operators.candidates import candidate_docs, candidates_long, token_arrays, tokens_long
from toponymic.operators.match import Gazetteer
from toponymic.operators.names import broadcast_if_bounded
from toponymic.operators.phrase_entities import phrase_docs
from toponymic.operators.tokens import exact_token_matches, ngram_matches, noun_names
from toponymic.plans import oracle as O
from toponymic.plans.jobs import match_corpus, with_article_meta
from toponymic.sources.articles import META_FIELDS
from toponymic.sources.corpus import spread
from toponymic.sources.fixture import fixture_countries, fixture_places, read_table

MATCH_COLS = ["doc_id", "row_index", "geonameid", "name", "countrycode"]
CAND_MATCH_COLS = ["doc_id", "cand_id", "row_index", "geonameid", "name", "countrycode"]
WHOLE_WORD_PHRASE = "of the"   # fixed value: the constant phrase of the F1 query
SLICE_OFFSET, SLICE_LEN = 899, 100   # fixed values: the reference's 100-article slice


@dataclass
class Inputs:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def docs(self) -> DataFrame:
        return spread(self.table("documents"), "doc_id")

    @cached_property
    def pages(self) -> DataFrame:
        return spread(self.table("pages"), "page_id")

    @cached_property
    def places(self) -> DataFrame:
        return fixture_places(self.table("benchmark"))

    @cached_property
    def countries(self) -> DataFrame:
        return fixture_countries(self.table("benchmark"), self.table("nation"))

    @cached_property
    def gaz(self) -> Gazetteer:
        return Gazetteer(self.places, self.countries)

    @cached_property
    def entity_lexicon(self) -> DataFrame:
        """Fixture lexicon of the entity strategy: country names are proper nouns (the
        trained entity chunker the reference uses labels them as places)."""
        return self.countries.select(F.col("country").alias("token"), F.lit("NNP").alias("tag"))

    @cached_property
    def entity_phrases(self) -> DataFrame:
        """Fixture phrase list of the entity strategy: every place and country name."""
        return self.places.select(F.col("name").alias("phrase")).unionByName(
            self.countries.select(F.col("country").alias("phrase")))

    @cached_property
    def nouns(self) -> DataFrame:
        return noun_names(self.places)

    def matches(self, keep: tuple[str, ...] = ()) -> DataFrame:
        return match_corpus(self.docs, self.gaz, on="text", keep=keep)


_INPUTS: dict[tuple, Inputs] = {}


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    key = (spark.conf.get("spark.app.id", None) or id(spark), sf_dir)
    if key not in _INPUTS:
        _INPUTS[key] = Inputs(spark, sf_dir)
    return _INPUTS[key]


# --------------------------------------------------------------------------- matching
def q_place_match(spark, sf_dir):
    return inputs(spark, sf_dir).matches().select(*MATCH_COLS)


def q_country_match(spark, sf_dir):
    i = inputs(spark, sf_dir)
    return i.gaz.countries_in(i.gaz.text_units(i.docs))


def q_country_gate(spark, sf_dir):
    """Per document: places admitted by the gate, ungated and gated place matches."""
    i = inputs(spark, sf_dir)
    units = i.gaz.text_units(i.docs)
    single_pass = i.gaz.gate_counts(units)
    if single_pass is not None:
        return single_pass
    # general form: three inputs combined per document
    per_country = i.places.groupBy(F.col("countrycode").alias("iso")).agg(F.count(F.lit(1)).alias("n"))
    found = i.gaz.countries_in(units)
    admitted = found.join(broadcast_if_bounded(per_country), "iso") \
                    .select("doc_id", F.col("n").alias("a"), F.lit(0).cast("long").alias("u"),
                            F.lit(0).cast("long").alias("g"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ungated = i.gaz.places_in(units, gate=False).select("doc_id", none.alias("a"), one.alias("u"), none.alias("g"))
    gated = i.gaz.places_in(units).select("doc_id", none.alias("a"), none.alias("u"), one.alias("g"))
    zeros = i.docs.select("doc_id", *[none.alias(c) for c in "aug"])
    return (zeros.unionByName(admitted).unionByName(ungated).unionByName(gated)
                 .groupBy("doc_id")
                 .agg(F.sum("a").alias("n_admitted"), F.sum("u").alias("n_ungated"), F.sum("g").alias("n_gated")))


def q_match_export(spark, sf_dir):
    i = inputs(spark, sf_dir)
    meta = ("year", "pub_type", "journal", "doi", "pmid")
    m = match_corpus(with_article_meta(i.docs), i.gaz, on="text", keep=meta)
    return report.export_matches(m)


def q_doc_match_counts(spark, sf_dir):
    i = inputs(spark, sf_dir)
    return report.doc_match_counts(i.docs, i.matches())


def q_run_totals(spark, sf_dir):
    i = inputs(spark, sf_dir)
    return report.run_totals(report.doc_match_counts(i.docs, i.matches()), i.table("documents").select("doc_id"))


def q_place_counts(spark, sf_dir):
    i = inputs(spark, sf_dir)
    return report.place_counts(i.matches(), i.places)


def q_reporting_effort(spark, sf_dir):
    i = inputs(spark, sf_dir)
    return report.reporting_effort(i.matches(keep=("lang",)))


def q_conversation_place_match(spark, sf_dir):
    """M1 over a second corpus: every conversation turn is an article of its own."""
    i = inputs(spark, sf_dir)
    turns = spread(i.table("conversations"), "conv_id", "turn").select(
        F.struct("conv_id", "turn").alias("doc_id"), "role", "text")
    m = match_corpus(turns, i.gaz, on="text", keep=("role",))
    return m.select("doc_id.conv_id", "doc_id.turn", "role", "row_index", "name", "countrycode")


def q_effort_by_quality(spark, sf_dir):
    """A4 grouped by the quality label; documents without a label form a group of their
    own (null). The label table is joined after the matches are reduced to one row per
    document and country."""
    i = inputs(spark, sf_dir)
    per_doc = i.matches().groupBy("doc_id", "countrycode").agg(F.count(F.lit(1)).alias("n"))
    labels = i.table("labels").select("doc_id", "quality")
    return (per_doc.join(labels, "doc_id", "left")
                   .groupBy(F.col("countrycode").alias("iso"), "quality")
                   .agg(F.sum("n").alias("n_matches"), F.count(F.lit(1)).alias("n_docs")))


def q_union_runs(spark, sf_dir):
    i = inputs(spark, sf_dir)
    en = F.col("lang") == "en"
    runs = {"en": match_corpus(i.docs.where(en), i.gaz).select(*MATCH_COLS),
            "other": match_corpus(i.docs.where(~en | F.col("lang").isNull()), i.gaz).select(*MATCH_COLS)}
    return report.union_runs(runs)


def q_whole_word_filter(spark, sf_dir):
    d = inputs(spark, sf_dir).docs
    return d.where(whole_word(F.col("text"), F.lit(WHOLE_WORD_PHRASE))).select("doc_id", "lang")


def q_corpus_slice(spark, sf_dir):
    d = inputs(spark, sf_dir).docs
    return d.select("doc_id", "lang", "source", "n_chars").orderBy("doc_id").offset(SLICE_OFFSET).limit(SLICE_LEN)


# --------------------------------------------------------------------------- markup
def q_tag_text(spark, sf_dir):
    pages = inputs(spark, sf_dir).pages
    return with_tag_text(pages.select("page_id", "html"), "html", "p").select("page_id", "text")


def _marked_up(docs: DataFrame) -> DataFrame:
    """Every document as an article: metadata from its columns, traps beside them."""
    escaped = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&#x3c;"))
    parts = ["<!DOCTYPE article PUBLIC 'a' 'b.dtd'><article><front><!-- <journal-title>Old</journal-title> -->",
             "<journal-title>", escaped(F.coalesce("lang", F.lit(""))), " &amp; Co &#xe9;</journal-title>",
             "<article-id pub-id-type='doi'/><article-id x-pub-id-type='pmid'>0</article-id>",
             "<article-id pub-id-type=\"pmid\">", F.col("doc_id").cast("string"), "</article-id>",
             "<pub-date pub-type=\"e'", F.coalesce("source", F.lit("")), "\"><year> ",
             (1990 + F.col("doc_id") % 30).cast("string"), " </year></pub-date></front><body><p>A list <list><list-item><p>",
             escaped(F.coalesce("text", F.lit(""))), "</p></list-item></list> ends</p></body></article>"]
    return docs.select("doc_id", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("markup"))


def q_article_meta(spark, sf_dir):
    """P1 and P2 over the documents written out as articles."""
    parsed = with_article_fields(_marked_up(inputs(spark, sf_dir).docs), "markup")
    return parsed.select("doc_id", *[F.col("meta")[f].alias(f) for f in META_FIELDS], F.md5("text").alias("text_md5"))


def q_page_meta(spark, sf_dir):
    pages = inputs(spark, sf_dir).pages
    html_attrs = markup.start_tag_attrs("html", "html")
    article = markup.element_content(markup.first_element("html", "article"), "article")
    host = F.regexp_extract("url", HOST_PATTERN, 1)
    return pages.select(
        "page_id",
        markup.first_text("html", "title").alias("title"),
        markup.attribute(html_attrs, "lang").alias("lang"),
        F.when(host != "", host).alias("host"),
        markup.first_text(article, "h1").alias("heading"))


HOST_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)"


# --------------------------------------------------------------------------- tokens and candidates
def q_tokens(spark, sf_dir):
    return tokens_long(token_arrays(inputs(spark, sf_dir).docs), with_tags=False)


def q_tagged_tokens(spark, sf_dir):
    return tokens_long(token_arrays(inputs(spark, sf_dir).docs))


def q_np_candidates(spark, sf_dir):
    return candidates_long(candidate_docs(token_arrays(inputs(spark, sf_dir).docs), "noun_phrases"))


def q_entity_candidates(spark, sf_dir):
    i = inputs(spark, sf_dir)
    return candidates_long(candidate_docs(token_arrays(i.docs), "entities", lexicon=i.entity_lexicon))


def q_candidate_country_match(spark, sf_dir):
    i = inputs(spark, sf_dir)
    per_doc = i.gaz.candidate_docs(candidate_docs(token_arrays(i.docs), "noun_phrases"))
    return i.gaz.countries_in(per_doc)


def q_candidate_place_match(spark, sf_dir):
    i = inputs(spark, sf_dir)
    return match_corpus(i.docs, i.gaz, on="noun_phrases").select(*CAND_MATCH_COLS)


def q_entity_place_match(spark, sf_dir):
    i = inputs(spark, sf_dir)
    return match_corpus(i.docs, i.gaz, on="entities", lexicon=i.entity_lexicon).select(*CAND_MATCH_COLS)


def q_tagged_place_match(spark, sf_dir):
    """M2 with supplied tags: the tokens, their tags and an entity flag come as a table."""
    i = inputs(spark, sf_dir)
    tagged = tokens_long(token_arrays(i.docs), lexicon=i.entity_lexicon).withColumn("entity", F.col("tag") == "NNP")
    return match_corpus(None, i.gaz, on="entities", tagged=tagged, entity_col="entity").select(*CAND_MATCH_COLS)


def q_phrase_entities(spark, sf_dir):
    """X5 with a phrase list: its leftmost-longest matches in every document."""
    i = inputs(spark, sf_dir)
    return candidates_long(phrase_docs(token_arrays(i.docs), i.entity_phrases))


def q_phrase_place_match(spark, sf_dir):
    """M2 with a phrase list: gated place matches over the phrases found."""
    i = inputs(spark, sf_dir)
    return match_corpus(i.docs, i.gaz, on="entities", phrases=i.entity_phrases).select(*CAND_MATCH_COLS)


#: Bytes of text above which ``long_document_match`` cuts a document into pieces.
SPLIT_OVER = 4096


def q_long_document_match(spark, sf_dir):
    """M1 with documents of over 4 KB matched in pieces by many tasks: the rows of ``place_match``."""
    i = inputs(spark, sf_dir)
    return match_corpus(i.docs, i.gaz, split_over=SPLIT_OVER).select("doc_id", "row_index", "geonameid", "name", "countrycode")


def as_patterns(places):
    """The gazetteer with every name written as a pattern of the same meaning: its fourth character as a class."""
    n = F.col("name")
    return places.withColumn("name", F.concat(F.substring(n, 1, 3), F.lit("["), F.substring(n, 4, 1), F.lit("]"),
                                              F.substr(n, F.lit(5))))


def q_pattern_place_match(spark, sf_dir):
    """F1 with names that are patterns: no name has a word to join on, all are found by the ends of the words they match."""
    i = inputs(spark, sf_dir)
    gaz = i.gaz.prepared("patterns", lambda: Gazetteer(as_patterns(i.gaz.places), i.gaz.countries, regex_names=True))
    return match_corpus(i.docs, gaz).select("doc_id", "row_index", "geonameid", F.col("asciiname").alias("name"), "countrycode")


def q_token_exact_match(spark, sf_dir):
    i = inputs(spark, sf_dir)
    return exact_token_matches(i.docs, i.nouns)


def q_ngram_match(spark, sf_dir):
    i = inputs(spark, sf_dir)
    return ngram_matches(i.docs, i.gaz).select("doc_id", "pos", "n", "row_index", "name", "countrycode")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "place_match": q_place_match,
    "country_match": q_country_match,
    "country_gate": q_country_gate,
    "match_export": q_match_export,
    "doc_match_counts": q_doc_match_counts,
    "run_totals": q_run_totals,
    "place_counts": q_place_counts,
    "reporting_effort": q_reporting_effort,
    "union_runs": q_union_runs,
    "conversation_place_match": q_conversation_place_match,
    "effort_by_quality": q_effort_by_quality,
    "whole_word_filter": q_whole_word_filter,
    "corpus_slice": q_corpus_slice,
    "tag_text": q_tag_text,
    "page_meta": q_page_meta,
    "article_meta": q_article_meta,
    "tokens": q_tokens,
    "tagged_tokens": q_tagged_tokens,
    "np_candidates": q_np_candidates,
    "entity_candidates": q_entity_candidates,
    "candidate_country_match": q_candidate_country_match,
    "candidate_place_match": q_candidate_place_match,
    "entity_place_match": q_entity_place_match,
    "tagged_place_match": q_tagged_place_match,
    "phrase_entities": q_phrase_entities,
    "phrase_place_match": q_phrase_place_match,
    "long_document_match": q_long_document_match,
    "pattern_place_match": q_pattern_place_match,
    "token_exact_match": q_token_exact_match,
    "ngram_match": q_ngram_match,
}


# =========================================================================== oracles
def _tag_case(tok: str) -> str:
    def words(ws):
        return ", ".join(f"'{w}'" for w in ws)
    adj = " OR ".join(f"suffix({tok}, '{s}')" for s in textf.ADJ_SUFFIXES)
    return (f"CASE WHEN regexp_matches({tok}, '^[^\\p{{L}}\\p{{N}}_]') THEN '.' "
            f"WHEN regexp_matches({tok}, '^[0-9]+$') THEN 'CD' "
            f"WHEN lower({tok}) IN ({words(textf.DT_WORDS)}) THEN 'DT' "
            f"WHEN lower({tok}) IN ({words(textf.IN_WORDS)}) THEN 'IN' "
            f"WHEN lower({tok}) IN ({words(textf.CC_WORDS)}) THEN 'CC' "
            f"WHEN lower({tok}) IN ({words(textf.VB_WORDS)}) THEN 'VB' "
            f"WHEN lower({tok}) IN ({words(textf.TO_WORDS)}) THEN 'TO' "
            f"WHEN regexp_matches({tok}, '^\\p{{Lu}}') THEN 'NNP' "
            f"WHEN suffix({tok}, '{textf.ADVERB_SUFFIX}') THEN 'RB' "
            f"WHEN suffix({tok}, '{textf.GERUND_SUFFIX}') THEN 'VBG' "
            f"WHEN suffix({tok}, '{textf.PAST_SUFFIX}') THEN 'VBD' "
            f"WHEN {adj} THEN 'JJ' "
            f"WHEN suffix({tok}, '{textf.PLURAL_SUFFIX}') THEN 'NNS' ELSE 'NN' END")


def _tokens_cte(name: str, strip: bool) -> str:
    src = "translate(text, '()', '')" if strip else "text"
    return (f"{name} AS (SELECT doc_id, unnest(l) AS token, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos "
            f"FROM (SELECT doc_id, regexp_extract_all({src}, '{O.TOKEN}') AS l FROM documents))")


def _tagged_cte(name: str, src: str, lexicon: str | None = None) -> str:
    tag = _tag_case("token")
    if lexicon:
        listed = f"(SELECT token AS listed, min(tag) AS known FROM {lexicon} GROUP BY token)"
        return (f"{name} AS MATERIALIZED (SELECT doc_id, pos, token, coalesce(known, {tag}) AS tag "
                f"FROM {src} LEFT JOIN {listed} ON listed = token)")
    return f"{name} AS (SELECT doc_id, pos, token, {tag} AS tag FROM {src})"


TAGGED = ",".join([_tokens_cte("tk", True), _tagged_cte("tg", "tk")])
# entity strategy: the fixture lexicon tags country names NNP
ENTITY_TAGGED = ",".join(["lex AS (SELECT country AS token, 'NNP' AS tag FROM country)",
                          _tagged_cte("tge", "tk", "lex")])

_CLASS = "CASE WHEN tag = 'JJ' THEN 'J' WHEN tag = 'NNP' THEN 'P' WHEN tag LIKE 'NN%' THEN 'N' ELSE 'O' END"

CANDIDATES = rf"""
cl AS (SELECT doc_id, pos, token, {_CLASS} AS c FROM tg),
cl2 AS (SELECT *, lag(c) OVER (PARTITION BY doc_id ORDER BY pos) AS pc FROM cl),
npg AS (SELECT *, sum(CASE WHEN c <> 'O' AND (pc IS NULL OR pc = 'O' OR (c = 'J' AND pc IN ('N', 'P')))
                           THEN 1 ELSE 0 END)
                  OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS gid FROM cl2),
np AS (SELECT doc_id, min(pos) AS cand_id, string_agg(token, ' ' ORDER BY pos) || ' ' AS phrase
       FROM npg WHERE c <> 'O' GROUP BY doc_id, gid HAVING max(CASE WHEN c IN ('N', 'P') THEN 1 ELSE 0 END) = 1)"""

ENTITY_CANDIDATES = rf"""
ecl AS (SELECT doc_id, pos, token, {_CLASS} AS c FROM tge),
ecl2 AS (SELECT *, lag(c) OVER (PARTITION BY doc_id ORDER BY pos) AS pc FROM ecl),
eng AS (SELECT *, sum(CASE WHEN c = 'P' AND (pc IS NULL OR pc <> 'P') THEN 1 ELSE 0 END)
                  OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS gid FROM ecl2),
ent AS MATERIALIZED (SELECT doc_id, min(pos) AS cand_id, string_agg(token, ' ' ORDER BY pos) || ' ' AS phrase
        FROM eng WHERE c = 'P' GROUP BY doc_id, gid)"""


# names of the phrase list have one or two words, so of overlapping matches every other one stays
PHRASE_ENTITIES = """
ph AS (SELECT name FROM place UNION SELECT country AS name FROM country),
pw AS (SELECT doc_id, pos, token, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS follows FROM tk),
ps AS (SELECT pw.doc_id, pw.pos, coalesce(b.name, a.name) AS name, CASE WHEN b.name IS NULL THEN 1 ELSE 2 END AS n
       FROM pw LEFT JOIN ph b ON b.name = pw.token || ' ' || pw.follows LEFT JOIN ph a ON a.name = pw.token
       WHERE a.name IS NOT NULL OR b.name IS NOT NULL),
pg AS (SELECT *, CASE WHEN lag(pos + n) OVER (PARTITION BY doc_id ORDER BY pos) > pos THEN 0 ELSE 1 END AS starts FROM ps),
pi AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS gid FROM pg),
pk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, gid ORDER BY pos) AS k FROM pi),
pent AS MATERIALIZED (SELECT doc_id, pos AS cand_id, name || ' ' AS phrase FROM pk WHERE k % 2 = 1)"""


def _candidate_matches(src: str) -> str:
    """Gated, bag-semantics place matches over candidate table ``src``."""
    return rf"""
cw AS MATERIALIZED (SELECT DISTINCT doc_id, cand_id, unnest(regexp_extract_all(phrase, '{O.W}+')) AS tok FROM {src}),
chit AS (SELECT DISTINCT cw.doc_id, c.iso FROM cw JOIN country c ON cw.tok = c.country),
cum AS MATERIALIZED (
  SELECT cw.doc_id, cw.cand_id, p.* FROM cw JOIN place p ON cw.tok = p.name
  UNION ALL
  SELECT n.doc_id, n.cand_id, p.* EXCLUDE (w1, w2) FROM cw JOIN place2 p ON cw.tok = p.w1
  JOIN cw c2 ON c2.doc_id = cw.doc_id AND c2.cand_id = cw.cand_id AND c2.tok = p.w2
  JOIN {src} n ON n.doc_id = cw.doc_id AND n.cand_id = cw.cand_id
  WHERE {O.boundary_match('n.phrase', 'p.name')}),
cm AS (SELECT cum.* FROM cum JOIN chit h ON h.doc_id = cum.doc_id AND h.iso = cum.countrycode)"""


def _decode(expr: str) -> str:
    for entity, char in markup.ENTITIES:
        expr = f"replace({expr}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return expr


def _inner_text(expr: str) -> str:
    return _decode(f"regexp_replace({expr}, '{markup.ANY_TAG}', '', 'g')")


def _first_text(src: str, tag: str) -> str:
    pat = markup.element_pattern(tag)
    content = f"regexp_extract({src}, '{pat}', 2)"
    return f"CASE WHEN regexp_extract({src}, '{pat}', 0) <> '' THEN {_inner_text(content)} END"


def _attribute(attrs: str, attr: str) -> str:
    pat = markup.attribute_pattern(attr).replace("'", "''")
    quoted = f"regexp_extract({attrs}, '{pat}', 2)"
    return f"CASE WHEN {quoted} <> '' THEN substr({quoted}, 2, length({quoted}) - 2) END"


def _tag_text_sql(col: str, tag: str) -> str:
    noise = f"regexp_replace({col}, '{markup.NOISE}', '', 'g')"
    marked = f"regexp_replace({noise}, '{markup.open_tag(tag)}', chr(1), 'g')"
    cut = f"regexp_replace(f, '{markup.cut_after(tag)}', '')"
    parts = f"string_split({marked}, chr(1))"
    return (f"array_to_string(list_transform(list_slice({parts}, 2, len({parts})), "
            f"lambda f: {_inner_text(cut)} || chr(10) || chr(10)), '')")


G = O.GAZETTEER
GM = (O.GAZETTEER, O.DOC_WORDS, O.MATCHES)

ORACLES: dict[str, str] = {
    "place_match": O.with_ctes(*GM, body="SELECT doc_id, row_index, geonameid, name, countrycode FROM m"),
    "pattern_place_match": O.with_ctes(*GM, body="SELECT doc_id, row_index, geonameid, name, countrycode FROM m"),
    "long_document_match": O.with_ctes(*GM, body="SELECT doc_id, row_index, geonameid, name, countrycode FROM m"),
    "country_match": O.with_ctes(G, O.DOC_WORDS, body="SELECT doc_id, iso FROM hit"),
    "country_gate": O.with_ctes(*GM, """
adm AS (SELECT h.doc_id, count(*) AS n FROM hit h JOIN place p ON p.countrycode = h.iso GROUP BY h.doc_id),
ung AS (SELECT doc_id, count(*) AS n FROM um GROUP BY doc_id),
gat AS (SELECT doc_id, count(*) AS n FROM m GROUP BY doc_id)""", body="""
SELECT d.doc_id, CAST(coalesce(adm.n, 0) AS BIGINT) AS n_admitted, CAST(coalesce(ung.n, 0) AS BIGINT) AS n_ungated,
       CAST(coalesce(gat.n, 0) AS BIGINT) AS n_gated
FROM documents d LEFT JOIN adm ON adm.doc_id = d.doc_id LEFT JOIN ung ON ung.doc_id = d.doc_id
LEFT JOIN gat ON gat.doc_id = d.doc_id"""),
    "match_export": O.with_ctes(*GM, body="""
SELECT m.doc_id, m.geonameid, m.name, m.asciiname, m.latitude, m.longitude, m.population,
       CAST(NULL AS INTEGER) AS year, d.source AS pub_type, d.lang AS journal, CAST(NULL AS VARCHAR) AS doi,
       CAST(d.doc_id AS VARCHAR) AS pmid, m.row_index
FROM m JOIN documents d ON d.doc_id = m.doc_id"""),
    "doc_match_counts": O.with_ctes(*GM, body="""
SELECT d.doc_id, count(m.row_index) AS n_matches FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id
GROUP BY d.doc_id"""),
    "run_totals": O.with_ctes(*GM, """
c AS (SELECT d.doc_id, count(m.row_index) AS n FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id GROUP BY d.doc_id)""",
                              body="""
SELECT count(*) AS articles_total, count(*) AS articles_processed, count_if(n > 0) AS articles_with_match,
       CAST(coalesce(sum(n), 0) AS BIGINT) AS total_matches,
       round(100.0 * count(*) / (SELECT count(*) FROM documents), 2) AS percent_complete FROM c"""),
    "place_counts": O.with_ctes(*GM, body="""
SELECT c.row_index, p.geonameid, p.name, p.countrycode, c.n AS "count"
FROM (SELECT row_index, count(*) AS n FROM m GROUP BY row_index) c LEFT JOIN place p ON p.row_index = c.row_index"""),
    "reporting_effort": O.with_ctes(*GM, body="""
SELECT m.countrycode AS iso, d.lang, count(*) AS n_matches, count(DISTINCT m.doc_id) AS n_docs
FROM m JOIN documents d ON d.doc_id = m.doc_id GROUP BY ROLLUP (m.countrycode, d.lang)"""),
    "union_runs": O.with_ctes(*GM, body="""
SELECT 'en' AS run, m.doc_id, m.row_index, m.geonameid, m.name, m.countrycode
FROM m JOIN documents d ON d.doc_id = m.doc_id WHERE d.lang = 'en'
UNION ALL
SELECT 'other' AS run, m.doc_id, m.row_index, m.geonameid, m.name, m.countrycode
FROM m JOIN documents d ON d.doc_id = m.doc_id WHERE d.lang <> 'en' OR d.lang IS NULL"""),
    "conversation_place_match": O.with_ctes(G, rf"""
ct AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(text, '{O.W}+')) AS tok FROM conversations),
chit AS (SELECT DISTINCT ct.conv_id, ct.turn, c.iso FROM ct JOIN country c ON ct.tok = c.country),
cum AS (
  SELECT ct.conv_id, ct.turn, p.* FROM ct JOIN place p ON ct.tok = p.name
  UNION ALL
  SELECT v.conv_id, v.turn, p.* EXCLUDE (w1, w2) FROM ct JOIN place2 p ON ct.tok = p.w1
  JOIN ct t2 ON t2.conv_id = ct.conv_id AND t2.turn = ct.turn AND t2.tok = p.w2
  JOIN conversations v ON v.conv_id = ct.conv_id AND v.turn = ct.turn
  WHERE {O.boundary_match('v.text', 'p.name')})""", body="""
SELECT cum.conv_id, cum.turn, v.role, cum.row_index, cum.name, cum.countrycode
FROM cum JOIN chit h ON h.conv_id = cum.conv_id AND h.turn = cum.turn AND h.iso = cum.countrycode
JOIN conversations v ON v.conv_id = cum.conv_id AND v.turn = cum.turn"""),
    "effort_by_quality": O.with_ctes(*GM, body="""
SELECT m.countrycode AS iso, l.quality, count(*) AS n_matches, count(DISTINCT m.doc_id) AS n_docs
FROM m LEFT JOIN labels l ON l.doc_id = m.doc_id GROUP BY m.countrycode, l.quality"""),
    "whole_word_filter": f"""
SELECT doc_id, lang FROM documents WHERE {O.boundary_match('text', "'" + WHOLE_WORD_PHRASE + "'")}""",
    "corpus_slice": f"""
SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT {SLICE_LEN} OFFSET {SLICE_OFFSET}""",
    "tag_text": f"SELECT page_id, {_tag_text_sql('html', 'p')} AS text FROM pages",
    "page_meta": f"""
SELECT page_id, {_first_text('html', 'title')} AS title,
       {_attribute("regexp_extract(html, '(?is)<html(\\s[^>]*)?>', 1)", 'lang')} AS lang,
       nullif(regexp_extract(url, '{HOST_PATTERN}', 1), '') AS host,
       {_first_text(f"regexp_extract(html, '{markup.element_pattern('article')}', 2)", 'h1')} AS heading
FROM pages""",
    "article_meta": """
SELECT doc_id, CAST(1990 + doc_id % 30 AS INTEGER) AS year, concat('e', chr(39), source) AS pub_type,
       concat(lang, ' & Co é') AS journal, CAST(NULL AS VARCHAR) AS doi, CAST(doc_id AS VARCHAR) AS pmid,
       md5(concat('A list ', text, ' ends', chr(10), chr(10), text, chr(10), chr(10))) AS text_md5
FROM documents""",
    "tokens": O.with_ctes(_tokens_cte("tk", True), body="SELECT doc_id, pos, token FROM tk"),
    "tagged_tokens": O.with_ctes(TAGGED, body="SELECT doc_id, pos, token, tag FROM tg"),
    "np_candidates": O.with_ctes(TAGGED, CANDIDATES, body="SELECT doc_id, cand_id, phrase FROM np"),
    "entity_candidates": O.with_ctes(G, TAGGED, ENTITY_TAGGED, ENTITY_CANDIDATES,
                                     body="SELECT doc_id, cand_id, phrase FROM ent"),
    "candidate_country_match": O.with_ctes(G, TAGGED, CANDIDATES, _candidate_matches("np"),
                                           body="SELECT doc_id, iso FROM chit"),
    "candidate_place_match": O.with_ctes(G, TAGGED, CANDIDATES, _candidate_matches("np"),
                                         body="SELECT doc_id, cand_id, row_index, geonameid, name, countrycode FROM cm"),
    "entity_place_match": O.with_ctes(G, TAGGED, ENTITY_TAGGED, ENTITY_CANDIDATES, _candidate_matches("ent"),
                                      body="SELECT doc_id, cand_id, row_index, geonameid, name, countrycode FROM cm"),
    "tagged_place_match": O.with_ctes(G, TAGGED, ENTITY_TAGGED, ENTITY_CANDIDATES, _candidate_matches("ent"),
                                      body="SELECT doc_id, cand_id, row_index, geonameid, name, countrycode FROM cm"),
    "phrase_entities": O.with_ctes(G, _tokens_cte("tk", True), PHRASE_ENTITIES, body="SELECT doc_id, cand_id, phrase FROM pent"),
    "phrase_place_match": O.with_ctes(G, _tokens_cte("tk", True), PHRASE_ENTITIES, _candidate_matches("pent"),
                                      body="SELECT doc_id, cand_id, row_index, geonameid, name, countrycode FROM cm"),
    "token_exact_match": O.with_ctes(G, _tokens_cte("tk0", False), _tagged_cte("tg0", "tk0"), body="""
SELECT doc_id, pos, token, tag FROM tg0 WHERE tag LIKE 'NN%' AND token IN (SELECT name FROM place)"""),
    "ngram_match": O.with_ctes(G, O.DOC_WORDS, _tokens_cte("tk2", False), """
ng AS (SELECT doc_id, pos, token AS g1,
              token || ' ' || lead(token, 1) OVER w AS g2,
              token || ' ' || lead(token, 1) OVER w || ' ' || lead(token, 2) OVER w AS g3
       FROM tk2 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
grams AS (SELECT doc_id, pos, 1 AS n, g1 AS gram FROM ng
          UNION ALL SELECT doc_id, pos, 2 AS n, g2 AS gram FROM ng WHERE g2 IS NOT NULL
          UNION ALL SELECT doc_id, pos, 3 AS n, g3 AS gram FROM ng WHERE g3 IS NOT NULL)""", body="""
SELECT g.doc_id, g.pos, g.n, p.row_index, p.name, p.countrycode
FROM grams g JOIN place p ON g.gram = p.name JOIN hit h ON h.doc_id = g.doc_id AND h.iso = p.countrycode"""),
}
