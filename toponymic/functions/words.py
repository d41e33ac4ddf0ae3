"""Word characters, word runs and whole-word predicates as Spark column expressions.

A *word character* is what Python's ``\\w`` accepts on ``str``: letters, numbers and the
underscore, i.e. ``[\\p{L}\\p{N}_]``. Java's ``\\b`` and ``(?U)\\w`` differ from that on
combining marks, so every boundary is written out with explicit look-arounds instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character classes shared by the Spark expressions and the SQL oracle.
WORD_CLASS = r"\p{L}\p{N}_"
WORD_RUN = r"[\p{L}\p{N}_]+"
NON_SPACE_MARK = r"[^\p{L}\p{N}_ \t\n\x0B\f\r]"
TOKEN = WORD_RUN + "|" + NON_SPACE_MARK
# The same for Java, faster: most words are small Latin letters, whose class is the cheapest to test.
JAVA_TOKEN = r"[a-z]++[\p{L}\p{N}_]*+|[\p{L}\p{N}_]++|" + NON_SPACE_MARK

# Python's \b at one position, written for Java regex: a change between word and
# non-word character (string ends count as non-word).
BOUNDARY = (r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])"
            r"|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))")

# Regex metacharacters escaped when a name is taken literally.
_META = r"([\\^$.|?*+()\[\]{}])"


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_runs(text: str | Column) -> Column:
    """All maximal word runs of ``text``, in order (array<string>)."""
    return F.regexp_extract_all(col_of(text), F.lit(WORD_RUN), 0)


def distinct_word_runs(text: str | Column) -> Column:
    return F.array_distinct(word_runs(text))


def escape_regex(name: str | Column) -> Column:
    return F.regexp_replace(col_of(name), _META, r"\\$1")


def boundary_pattern(name: str | Column, regex_names: bool = False) -> Column:
    """``\\b name \\b`` with Python's boundary semantics.

    With ``regex_names`` the name is used as a pattern, as the reference does; otherwise
    it is matched literally.
    """
    body = col_of(name) if regex_names else escape_regex(name)
    return F.concat(F.lit(BOUNDARY), body, F.lit(BOUNDARY))


def whole_word(text: str | Column, name: str | Column, regex_names: bool = False) -> Column:
    """True when ``name`` occurs in ``text`` as whole words (case-sensitive).

    For a literal name a cheap ``contains`` guards the regex, so the pattern only runs
    on texts that hold the name at all (``And`` short-circuits in generated code).
    """
    text_c, name_c = col_of(text), col_of(name)
    pattern = boundary_pattern(name_c, regex_names)
    regex_hit = F.regexp_like(text_c, pattern)
    if regex_names:
        return regex_hit
    return F.when(F.contains(text_c, name_c), regex_hit).otherwise(F.lit(False))


def longest_run(runs: Column, rank: int = 0) -> Column:
    """The ``rank``-th longest string of an array (ties: the smallest first); null when
    the array is shorter."""
    keyed = F.transform(runs, lambda r: F.struct((-F.length(r)).alias("k"), r.alias("v")))
    return F.get(F.sort_array(keyed), rank).getField("v")   # null (not an error) when absent


#: What separates the required parts of a pattern in ``required_text``; no character of a name.
BREAK = "\0"
#: Groups inside of groups that ``required_text`` sees through.
_DEPTH = 8


def required_text(pattern: Column) -> Column:
    """The characters that every match of a pattern holds, in order, ``BREAK`` between parts that
    needn't touch. A match holds each part whole. Where that can't be told – alternatives at the top,
    flags, look-arounds, quoting, nested classes – it is empty.

    Groups, classes, escapes and whatever is repeated or optional are breaks.
    """
    gone = F.lit(BREAK)
    text = F.regexp_replace(pattern, r"(?s)\\(?:[pP]\{[^}]*\}|.)", gone)      # escapes
    text = F.regexp_replace(text, r"\[\^?\]?[^\[\]]*\]", gone)                # classes
    for _ in range(_DEPTH):
        text = F.regexp_replace(text, r"\((?:\?:)?[^()?]*\)|\((?:\?:)?[^()]*[^()?][?][^()]*\)", gone)
    text = F.regexp_replace(text, r"(?s).(?:[*?]|\{[^}]*\})[+?]?", gone)        # optional, or counted
    text = F.regexp_replace(text, r"[+][+?]?|[.^$]", gone)
    unclear = pattern.rlike(r"\\[QExucN0]|\(\?(?!:)") | text.rlike(r"[()\[\]|{}*?\\]")
    return F.when(unclear, F.lit("")).otherwise(text)


#: Characters of a pattern's ends that are looked up: at most so many of each, and so many of one of them at least.
END_CHARS, LEAST_END_CHARS = 4, 3
#: Words of a pattern looked up that way, at most.
MAX_WINDOW = 4

# What a pattern may consist of whose words can be told: word characters, classes of them, groups, alternatives,
# repetitions and single characters between words.
_CLASS_OF_WORD = r"\[(?:a-z|A-Z|0-9|[\p{L}\p{N}_](?!-))+\]"
_COUNT = r"\{[0-9]+(?:,[0-9]*)?\}"
_MARK = r"[^\p{L}\p{N}_\\^$.|?*+()\[\]{}\x00]"
_CLEAR = rf"^(?:[{WORD_CLASS}]|{_CLASS_OF_WORD}|\\[dw]|\((?:\?:|(?!\?))|[)|?*+]|{_COUNT}|{_MARK})+$"
# Required text with a word character in each part between marks, none of which touch.
_PARTED = rf"^\x00*[{WORD_CLASS}][\x00{WORD_CLASS}]*(?:[^\x00{WORD_CLASS}]\x00*[{WORD_CLASS}][\x00{WORD_CLASS}]*)*$"


def whole_runs(required: Column) -> Column:
    """Word runs that stand as whole words in every match at word boundaries, from ``required_text``: nothing
    but a mark that must stand there too, or the end of the match, is next to them."""
    return F.regexp_extract_all(required, F.lit(rf"(?<![{WORD_CLASS}\x00])[{WORD_CLASS}]+(?![{WORD_CLASS}\x00])"), 0)


def phrase_ends(pattern: Column, required: Column) -> tuple[Column, Column, Column]:
    """The characters that each match of a pattern begins and ends with, and the number of its words.

    Null unless all matches are so many words with single other characters between them, which makes a match at word
    boundaries one of ``word_windows`` as a whole, and the ends are long enough to look up. Every mark of the
    pattern must be required, so none is optional or in a group.
    """
    marks = lambda c: F.regexp_count(c, F.lit(rf"[^\x00{WORD_CLASS}]"))     # noqa: E731
    signs = F.regexp_replace(pattern, rf"\(\?:|{_COUNT}|\\.|\[[^\]]*\]|[()|?*+]", "")
    lead, tail = (F.regexp_extract(required, end, 0) for end in (r"^[^\x00]*", r"[^\x00]*$"))
    known = F.greatest(F.length(lead), F.length(tail)) >= LEAST_END_CHARS
    held = pattern.rlike(_CLEAR) & required.rlike(_PARTED) & (marks(signs) == marks(required)) & known
    return F.when(held, lead), F.when(held, tail), F.when(held, marks(required) + 1)


def word_windows(text: Column, n: int) -> Column:
    """Every ``n`` words that follow each other in a text with one character between them, repeats included; an empty
    string for a word that no such words follow."""
    rest = rf"(?:[^{WORD_CLASS}][{WORD_CLASS}]++){{{n - 1}}}"
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=([{WORD_CLASS}]++{rest})|)[{WORD_CLASS}]++"), 1)


def trigrams(text: str | Column) -> Column:
    """All runs of three characters without a ``BREAK``, in order, repeats included."""
    return F.regexp_extract_all(col_of(text), F.lit(r"(?=([^\x00]{3}))"), 1)
