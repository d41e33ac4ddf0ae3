"""Tagged tokens and candidate phrases (X1-X6) as DataFrames.

Default path, one document row at a time (no shuffle): tokens and tags are arrays, and
the chunker's matches come from a regex over the position-coded tag string
(``functions.text``). Long-form tables are produced by ``posexplode``.

Supplied-tag path: when tags (or an entity flag) come from an external tagger as a long
table ``(doc_id, pos, token, tag)``, ``tagged_docs`` gathers each document's coded tokens with
one exchange on the document (tasks put their own tokens together first, and tokens outside of
any phrase travel without their text), and the same regex finds the phrases in the row. So
countries are known per document before a phrase is exploded. ``candidates_from_tagged``
is the long form of the same, as islands over a window ordered by ``pos``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from toponymic.functions.text import (ENTITY_SPAN, NP_SPAN, POS_WIDTH, entity_phrases, noun_phrases, span_cand_id,
                                      span_phrase, strip_parens, tag_class, tag_rule, token_array)
from toponymic.operators.names import MAX_LITERAL_NAMES, broadcast_if_bounded, collect_bounded

KINDS = ("noun_phrases", "entities")


def lexicon_table(lexicon: DataFrame | dict, spark: SparkSession | None = None) -> DataFrame:
    """(token, tag): one row per token, the smallest of its tags; null tokens are left out."""
    if isinstance(lexicon, dict):
        lexicon = (spark or SparkSession.getActiveSession()).createDataFrame(list(lexicon.items()), "token string, tag string")
    return lexicon.where(F.col("token").isNotNull()).groupBy("token").agg(F.min("tag").alias("tag"))


def lexicon_map(lexicon: DataFrame | dict | None) -> Column | None:
    """A lexicon as a map literal, checked before the rules; None without one. Raises
    ``LexiconTooLarge`` above ``MAX_LITERAL_NAMES`` entries, where callers join instead."""
    if isinstance(lexicon, DataFrame):
        rows = collect_bounded(lexicon_table(lexicon), MAX_LITERAL_NAMES)
        if rows is None:
            raise LexiconTooLarge
        lexicon = {r["token"]: r["tag"] for r in rows}
    elif lexicon and len(lexicon) > MAX_LITERAL_NAMES:
        raise LexiconTooLarge
    if not lexicon:
        return None
    keys, vals = zip(*sorted(lexicon.items()))
    return F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.lit(v) for v in vals]))


class LexiconTooLarge(ValueError):
    """The lexicon can't be inlined; tags come from a join."""


def tag_tokens(tokens: DataFrame, lexicon: DataFrame | dict | None = None) -> DataFrame:
    """Adds ``tag`` to a table with ``token``: from the lexicon, of any size, else by rule."""
    try:
        return tokens.select("*", tag_rule(F.col("token"), lexicon_map(lexicon)).alias("tag"))
    except LexiconTooLarge:
        known = lexicon_table(lexicon, tokens.sparkSession).withColumnRenamed("tag", "__tag")
        return (tokens.join(broadcast_if_bounded(known), "token", "left")
                      .select(*tokens.columns, F.coalesce(F.col("__tag"), tag_rule(F.col("token"), None)).alias("tag")))


def tokens_long(tok: DataFrame, with_tags: bool = True, lexicon: DataFrame | dict | None = None) -> DataFrame:
    """doc_id, pos (long, 0-based), token[, tag] – one row per token occurrence.

    The tag is computed after the explode, as a plain (code-generated) column, or joined
    where the lexicon is large.
    """
    out = (tok.select("doc_id", F.posexplode_outer("tokens").alias("pos", "token"))
              .where(F.col("token").isNotNull())
              .select("doc_id", F.col("pos").cast("long").alias("pos"), "token"))
    return tag_tokens(out, lexicon) if with_tags else out


def token_arrays(docs: DataFrame, text_col: str = "text", key: str = "doc_id", strip: bool = True,
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, the ``carry`` columns, tokens (no tags)."""
    text = strip_parens(text_col) if strip else F.col(text_col)
    return docs.select(F.col(key).alias("doc_id"), *carry, token_array(text).alias("tokens"))


def candidate_docs(tok: DataFrame, kind: str = "noun_phrases", carry: tuple[str, ...] = (),
                   lexicon: DataFrame | dict | None = None) -> DataFrame:
    """One row per document: doc_id, the ``carry`` columns and ``spans`` (array<string>,
    the chunker's coded spans; see ``functions.text.chunk_spans``).

    ``tok`` needs ``tokens`` (from ``token_arrays``); the tag class of each token is
    computed in the same pass that codes the tag string. The lexicon must fit a literal
    (``LexiconTooLarge``); ``plans.jobs`` takes the long path for a larger one.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    build = noun_phrases if kind == "noun_phrases" else entity_phrases
    return tok.select("doc_id", *carry, build(F.col("tokens"), lexicon_map(lexicon)).alias("spans"))


def candidates_long(cands: DataFrame) -> DataFrame:
    """doc_id, cand_id, phrase – one row per candidate (decoded after the explode)."""
    return (cands.select("doc_id", F.explode_outer("spans").alias("s"))
                 .where(F.col("s").isNotNull())
                 .select("doc_id", span_cand_id(F.col("s")).alias("cand_id"),
                         span_phrase(F.col("s")).alias("phrase")))


def _tagged_class(kind: str, entity_col: str | None) -> Column:
    """The class letter of a supplied token; ``entity_col`` replaces the default rule of entities."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    if kind == "entities":
        member = F.col(entity_col) if entity_col else (F.col("tag") == "NNP")
        return F.when(member, "P").otherwise("O")
    return tag_class(F.col("tag"))


def tagged_docs(tagged: DataFrame, kind: str = "noun_phrases", entity_col: str | None = None) -> DataFrame:
    """One row per document of a supplied long tag table: doc_id and ``spans`` (see
    ``functions.text.chunk_spans``), as ``candidate_docs`` has them.

    Tokens may be any strings; a line feed inside one counts as a vertical tab, a null token is empty,
    a null tag or flag is in no phrase. Positions order the tokens, need not be dense and lie
    between 0 and 10^9 - 1, else the job stops with an error; a token without a position can't be placed and is left
    out. Tokens with the same position are taken in the order of class and text. A document
    is one row of the result, as it is in a table of texts.
    """
    c = _tagged_class(kind, entity_col)
    pos = F.col("pos").cast("long")
    held = F.when(pos.between(0, 10 ** POS_WIDTH - 1), pos).otherwise(
        F.raise_error(F.lit(f"positions of supplied tokens have {POS_WIDTH} digits at most")).cast("long"))
    text = F.when(c != "O", F.coalesce(F.translate("token", "\n", "\x0b"), F.lit(""))).otherwise("")
    units = (tagged.where(F.col("pos").isNotNull())
                   .select("doc_id", F.struct(held.alias("pos"), c.alias("c"), text.alias("token")).alias("u")))
    per_doc = units.groupBy("doc_id").agg(F.array_sort(F.collect_list("u")).alias("u"))
    coded = F.array_join(F.transform("u", lambda x: F.concat(
        F.lit("\n"), x["c"], F.lpad(x["pos"].cast("string"), POS_WIDTH, "0"), x["token"])), "")
    return per_doc.select("doc_id", F.regexp_extract_all(coded, F.lit(ENTITY_SPAN if kind == "entities" else NP_SPAN), 0)
                          .alias("spans"))


def candidates_from_tagged(tagged: DataFrame, kind: str = "noun_phrases",
                           entity_col: str | None = None) -> DataFrame:
    """Candidate phrases from a supplied long tag table (doc_id, pos, token, tag).

    For ``kind='entities'`` an optional boolean ``entity_col`` replaces the default rule
    (token tagged ``NNP``). Returns doc_id, cand_id, phrase.
    """
    c = _tagged_class(kind, entity_col)
    w = Window.partitionBy("doc_id").orderBy("pos")
    coded = tagged.select("doc_id", "pos", "token", c.alias("c"))
    prev = F.lag("c").over(w)
    if kind == "entities":
        start = (F.col("c") == "P") & (prev.isNull() | (prev != "P"))
    else:
        start = (F.col("c") != "O") & (prev.isNull() | (prev == "O")
                                        | ((F.col("c") == "J") & prev.isin("N", "P")))
    grouped = (coded.withColumn("start", start.cast("int"))
                    .withColumn("gid", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
                    .where(F.col("c") != "O"))
    phrase = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))),
                                               lambda x: x["token"]), " "), F.lit(" "))
    return (grouped.groupBy("doc_id", "gid")
                   .agg(F.min("pos").cast("long").alias("cand_id"), phrase.alias("phrase"),
                        F.max(F.col("c").isin("N", "P").cast("int")).alias("has_noun"))
                   .where(F.col("has_noun") == 1)
                   .select("doc_id", "cand_id", "phrase"))
