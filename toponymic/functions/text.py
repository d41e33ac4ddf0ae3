"""Tokens, part-of-speech tags and candidate phrase spans as column expressions.

Everything works on one document row: tokens are an array, tags an array of the same
length, and candidate phrases are found by a regex over a *position-coded* tag string,
so no token-level shuffle is needed to rebuild a document's order.

Tagging is rule-based (our rules, not a trained model): the contract is the tag column,
which a caller may also supply from an external tagger (see ``operators.candidates``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from toponymic.functions.words import JAVA_TOKEN, col_of

# Closed word classes of the default tag rules, checked on lower case.
DT_WORDS = ["the", "a", "an", "this", "that"]
IN_WORDS = ["of", "in", "on", "at", "by", "for", "from", "with", "as"]
CC_WORDS = ["and", "or", "but"]
VB_WORDS = ["is", "are", "was", "be", "has", "have"]
TO_WORDS = ["to"]
# Suffix rules, first match wins.
ADVERB_SUFFIX = "ly"
GERUND_SUFFIX = "ing"
PAST_SUFFIX = "ed"
ADJ_SUFFIXES = ["ble", "al", "ous", "ive", "ful", "ic"]
PLURAL_SUFFIX = "s"

# Coded tag string: one unit per token, "\n" + class letter + zero-padded position + token.
# Tokens never contain whitespace, so a match can only start at a unit boundary, and each
# match carries its own tokens: no slicing of the token array inside a lambda.
# Quantifiers are possessive: Java's regex engine recurses once per repetition of a
# variable-width group (a long noun run would overflow the stack), possessive ones loop.
# Nothing is lost: giving back a J unit never lets [NP]+ match where it did not.
POS_WIDTH = 9   # positions up to 10**9 tokens per document
_UNIT = rf"\n[{{cls}}][0-9]{{{{{POS_WIDTH}}}}}[^\n]*+"
NP_SPAN = "(?:" + _UNIT.format(cls="J") + ")*+(?:" + _UNIT.format(cls="NP") + ")++"
ENTITY_SPAN = "(?:" + _UNIT.format(cls="P") + ")++"
_UNIT_TOKEN = rf"\n[JNPO][0-9]{{{POS_WIDTH}}}([^\n]*)"


def strip_parens(text: str | Column) -> Column:
    """Delete '(' and ')'."""
    t = col_of(text)    # translate() looks every character up, and most texts have none of the two
    return F.when(F.contains(t, F.lit("(")) | F.contains(t, F.lit(")")), F.regexp_replace(t, "[()]", "")).otherwise(t)


def token_array(text: str | Column) -> Column:
    """Word runs and single marks, in order."""
    return F.regexp_extract_all(col_of(text), F.lit(JAVA_TOKEN), 0)


def _first(tok: Column) -> Column:
    return F.substring(tok, 1, 1)


def _is_mark(tok: Column) -> Column:
    """First character is not a word character (tested on that character only)."""
    return _first(tok).rlike(r"^[^\p{L}\p{N}_]")


def _is_number(tok: Column) -> Column:
    return _first(tok).between("0", "9") & tok.rlike("^[0-9]+$")


def _is_capital(tok: Column) -> Column:
    return _first(tok).rlike(r"^\p{Lu}")


def tag_rule(tok: Column, lexicon: Column | None = None) -> Column:
    """The tag of one token. ``lexicon`` is an optional map<string,string> (checked first)."""
    low = F.lower(tok)
    rules = (F.when(_is_mark(tok), ".")
              .when(_is_number(tok), "CD")
              .when(low.isin(DT_WORDS), "DT")
              .when(low.isin(IN_WORDS), "IN")
              .when(low.isin(CC_WORDS), "CC")
              .when(low.isin(VB_WORDS), "VB")
              .when(low.isin(TO_WORDS), "TO")
              .when(_is_capital(tok), "NNP")
              .when(tok.endswith(ADVERB_SUFFIX), "RB")
              .when(tok.endswith(GERUND_SUFFIX), "VBG")
              .when(tok.endswith(PAST_SUFFIX), "VBD")
              .when(_any([tok.endswith(s) for s in ADJ_SUFFIXES]), "JJ")
              .when(tok.endswith(PLURAL_SUFFIX), "NNS")
              .otherwise("NN"))
    if lexicon is None:
        return rules
    return F.coalesce(F.element_at(lexicon, tok), rules)


def _any(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def tag_array(tokens: Column, lexicon: Column | None = None) -> Column:
    return F.transform(tokens, lambda t: tag_rule(t, lexicon))


def tag_class(tag: Column) -> Column:
    """One letter per tag: J = JJ exactly, P = NNP, N = other NN*, O = anything else."""
    return (F.when(tag == "JJ", "J").when(tag == "NNP", "P")
             .when(tag.startswith("NN"), "N").otherwise("O"))


def class_rule(tok: Column, lexicon: Column | None = None, coded=lambda c: F.lit(c)) -> Column:
    """``tag_class(tag_rule(tok))`` as one CASE: the classes of the default rules
    (closed classes, marks, digits and RB/VBG/VBD suffixes are O; JJ suffixes J; initial
    capital P; NN and NNS N). ``coded`` makes the result from a class letter.

    Most tokens begin with a small Latin letter: those skip the tests of the first character."""
    closed = DT_WORDS + IN_WORDS + CC_WORDS + VB_WORDS + TO_WORDS
    is_closed = (F.length(tok) <= max(map(len, closed))) & F.lower(tok).isin(closed)
    small = (tok >= "a") & (tok < "{")
    rules = (F.when(~small & (_is_mark(tok) | _is_number(tok)) | is_closed, coded("O"))
              .when(~small & _is_capital(tok), coded("P"))
              .when(_any([tok.endswith(s) for s in (ADVERB_SUFFIX, GERUND_SUFFIX, PAST_SUFFIX)]), coded("O"))
              .when(_any([tok.endswith(s) for s in ADJ_SUFFIXES]), coded("J"))
              .otherwise(coded("N")))
    if lexicon is None:
        return rules
    listed = F.element_at(lexicon, tok)
    given = tag_class(listed)
    return F.when(listed.isNotNull(), F.when(given == "J", coded("J")).when(given == "P", coded("P")).when(given == "N", coded("N"))
                  .otherwise(coded("O"))).otherwise(rules)


def coded_pos(pos: Column) -> Column:
    """A position below 10^9 in ``POS_WIDTH`` digits (by a sum: lpad is slower)."""
    return F.substring((pos + 10 ** POS_WIDTH).cast("string"), 2, POS_WIDTH)


def coded_units(tokens: Column, lexicon: Column | None = None) -> Column:
    """The coded tag string of a document (see ``NP_SPAN``). Tokens outside of any phrase are the letter alone."""
    def unit(t: Column, i: Column) -> Column:
        return class_rule(t, lexicon, lambda c: F.lit("\nO") if c == "O" else F.concat(F.lit("\n" + c), coded_pos(i), t))

    return F.array_join(F.transform(tokens, unit), "")


def chunk_spans(tokens: Column, pattern: str, lexicon: Column | None = None) -> Column:
    """array<string>: the coded units of each leftmost, greedy, non-overlapping match of
    ``pattern`` over the tag classes (the chunker's semantics). Decode with
    ``span_cand_id`` / ``span_phrase`` (after an explode they run in generated code)."""
    return F.regexp_extract_all(coded_units(tokens, lexicon), F.lit(pattern), 0)


def span_cand_id(span: Column) -> Column:
    """Position of the span's first token."""
    return F.substring(span, 3, POS_WIDTH).cast("long")


def span_phrase(span: Column) -> Column:
    """The span's words, each followed by one space."""
    return F.regexp_replace(span, _UNIT_TOKEN, "$1 ")


def spans_words(spans: Column) -> Column:
    """Distinct tokens of all spans of a document, in one regex pass."""
    return F.array_distinct(F.regexp_extract_all(F.array_join(spans, ""), F.lit(_UNIT_TOKEN), 1))


def chunk(tokens: Column, pattern: str, lexicon: Column | None = None) -> Column:
    """array<struct<cand_id:long, phrase:string>> of the chunks (see ``chunk_spans``)."""
    return F.transform(chunk_spans(tokens, pattern, lexicon), lambda m: F.struct(
        span_cand_id(m).alias("cand_id"), span_phrase(m).alias("phrase")))


def noun_phrases(tokens: Column, lexicon: Column | None = None) -> Column:
    """Spans of the grammar ``<JJ>*<NN.*>+``."""
    return chunk_spans(tokens, NP_SPAN, lexicon)


def entity_phrases(tokens: Column, lexicon: Column | None = None) -> Column:
    """X5 (default rule): spans of proper-noun runs."""
    return chunk_spans(tokens, ENTITY_SPAN, lexicon)
