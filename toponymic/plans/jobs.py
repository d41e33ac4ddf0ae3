"""Composite jobs (M1-M4): the whole match as one DataFrame job, choosing the strategy.

``on='text'``          full text (M1, M4): the reference's main job;
``on='noun_phrases'``  noun-phrase candidates (M3);
``on='entities'``      proper-noun runs as entity candidates (M2).

The corpus-wide and parallel forms of the reference (loops, pools, queues) are this same
job: Spark runs one task per input split on every executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toponymic.operators.candidates import (LexiconTooLarge, candidate_docs, tagged_docs, token_arrays,
                                            tokens_long)
from toponymic.operators.match import Gazetteer, places_in_text
from toponymic.operators.phrase_entities import phrase_docs

STRATEGIES = ("text", "noun_phrases", "entities")


def match_corpus(docs: DataFrame | None, gaz: Gazetteer, on: str = "text", text_col: str = "text",
                 keep: tuple[str, ...] = (), gate: bool = True, lexicon=None,
                 distinct: bool = False, tagged: DataFrame | None = None,
                 entity_col: str | None = None, split_over: int | None = None,
                 phrases: DataFrame | None = None) -> DataFrame:
    """Gated place matches: one row per (document[, candidate], place row).

    Candidate strategies keep the reference's bag semantics (a place named in two
    phrases is reported twice); ``distinct=True`` reduces them to one row per
    (document, place row), deduplicated map-side before a shuffle on that pair.

    ``tagged`` supplies the tokens and tags of another tagger (doc_id, pos, token, tag) for
    the candidate strategies, ``entity_col`` a boolean column of it that marks entities;
    ``docs`` is then only read for the ``keep`` columns. A lexicon too large to inline
    takes the same path, with tags joined to the tokens.

    ``phrases`` (entities only) is a list of entity names, of any size and of any number of tokens (column
    ``phrase``): its leftmost-longest matches are the candidates (``operators.phrase_entities``).

    ``split_over`` (full text only) has texts of more bytes matched in pieces, by many tasks
    (``operators.match.places_in_text``).
    """
    if on not in STRATEGIES:
        raise ValueError(f"on must be one of {STRATEGIES}")
    if on == "text":
        if tagged is not None or phrases is not None:
            raise ValueError("tags and phrase lists serve the candidate strategies only")
        return places_in_text(docs, gaz, text_col, gate, keep, split_over)
    if split_over is not None:
        raise ValueError("only full texts are matched in pieces")
    if phrases is not None and (on != "entities" or tagged is not None or lexicon is not None):
        raise ValueError("a phrase list replaces the entity rule, its tags and its lexicon")
    if tagged is None and phrases is None:
        try:
            per_doc = gaz.candidate_docs(candidates(docs, on, text_col, keep, lexicon))
        except LexiconTooLarge:
            tagged = tokens_long(token_arrays(docs, text_col), lexicon=lexicon)
    if tagged is None and phrases is None:
        found = gaz.places_in(gaz.candidate_units(per_doc, keep, gate), gate=gate, keep=keep)
    else:
        own_tokens = phrases is not None
        spans = phrase_docs(token_arrays(docs, text_col), phrases) if own_tokens else tagged_docs(tagged, on, entity_col)
        per_doc = gaz.candidate_docs(spans, any_tokens=not own_tokens)
        found = gaz.places_in(gaz.candidate_units(per_doc, gate=gate, any_tokens=not own_tokens), gate=gate)
        if keep:
            own = docs.select(F.col("doc_id").alias("__doc"), *keep)
            found = found.join(own, F.col("doc_id").eqNullSafe(F.col("__doc"))).drop("__doc")
    if distinct:
        return found.drop("cand_id").dropDuplicates(["doc_id", "row_index"])
    return found


def candidates(docs: DataFrame, on: str, text_col: str = "text", keep: tuple[str, ...] = (),
               lexicon=None) -> DataFrame:
    """One row per document: doc_id, the ``keep`` columns and its candidate array."""
    tok = token_arrays(docs.select("doc_id", text_col, *keep), text_col, carry=keep)
    return candidate_docs(tok, on, carry=keep, lexicon=lexicon)


def with_article_meta(docs: DataFrame, journal_col: str = "lang", pub_type_col: str = "source") -> DataFrame:
    """Metadata columns for the driver's documents, which carry no markup: ``lang`` and
    ``source`` stand in for journal and publication type, ``pmid`` is the document key,
    and ``year`` / ``doi`` are absent (null)."""
    return docs.select(
        "*",
        F.lit(None).cast("int").alias("year"),
        F.col(pub_type_col).alias("pub_type"),
        F.col(journal_col).alias("journal"),
        F.lit(None).cast("string").alias("doi"),
        F.col("doc_id").cast("string").alias("pmid"))
