"""Name index: how a gazetteer name is found in text by an equi-join.

A literal name that occurs at word boundaries has each of its word runs as a whole
word run of the text. So the matcher joins the text's distinct word runs with one run
of each name (its *anchor*), and only names of more than one run need a residual check
of the whole text. The anchor is the name's longest run, the rarest key in practice,
which keeps the join's key groups small.

With ``regex_names=True`` a name is a pattern, as in the reference. A run is still a
safe anchor when neither neighbour is a ``.`` (which may match a word character). Of the names
with any other metacharacter, those whose matches are a known number of words and single characters between them
are joined with a text's words on the characters at both ends (``ends_index``). The others are
anchored on a word that each of their matches must hold whole, if there is one, else joined on a run of three
characters that each must hold (``gram_index``); those without one go through the residual path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toponymic.functions.words import (BOUNDARY, BREAK, END_CHARS, escape_regex, MAX_WINDOW, longest_run, phrase_ends,
                                       required_text, trigrams, whole_runs, word_runs)

# Size bounds for data that is broadcast or inlined into the plan.
MAX_BROADCAST_NAMES = 2_000_000         # rows of a name index shipped to every executor
MAX_BROADCAST_BYTES = 256 * 1024 ** 2   # estimated bytes of the same
MAX_LITERAL_NAMES = 5_000               # rows inlined into an expression (country lists)

_SINGLE_RUN = r"^[\p{L}\p{N}_]+$"
_SAFE_RUN = r"(?<![\p{L}\p{N}_.])[\p{L}\p{N}_]+(?![\p{L}\p{N}_.])"
_META_NOT_DOT = r"[\\^$|?*+()\[\]{}]"
_META_ANY = r"[\\^$.|?*+()\[\]{}]"


def name_index(names: DataFrame, name_col: str = "name", regex_names: bool = False) -> DataFrame:
    """Add ``anchor``, ``second``, ``single``, ``guard`` and ``body`` to a table of names.

    * ``anchor``  – the word run joined on; null when the name has none usable.
    * ``second``  – another word run of a multi-run literal name (the next longest): it
                    must be among the text's words too, a cheap test before any scan.
    * ``single``  – the name is one word run, so the anchor equality is the whole test.
    * ``guard``   – a literal substring the text must contain (cheap pre-check).
    * ``body``    – the name as a regex body (escaped unless ``regex_names``); the
                    boundary regex is ``boundary(body)``, built where it is checked so
                    the broadcast index does not carry the boundary text per name.

    Null and empty names are dropped (a missing name would raise in the reference).
    """
    n = F.col(name_col)
    named = names.where(n.isNotNull() & (F.length(n) > 0))
    if regex_names:
        plain = ~n.rlike(_META_ANY)
        pattern, required = n.rlike(_META_NOT_DOT), required_text(n)
        anchor = F.when(pattern, longest_run(whole_runs(required))) \
                  .otherwise(longest_run(F.regexp_extract_all(n, F.lit(_SAFE_RUN), 0)))
        second = F.when(plain, longest_run(word_runs(n), 1))
        guard = F.when(plain, n).when(pattern, longest_run(F.split(required, BREAK))).otherwise(anchor)
        single = plain & n.rlike(_SINGLE_RUN)
    else:
        anchor = longest_run(word_runs(n))
        second = longest_run(word_runs(n), 1)
        guard = n
        single = n.rlike(_SINGLE_RUN)
    return named.select(
        "*",
        anchor.alias("anchor"),
        second.alias("second"),
        single.alias("single"),
        guard.alias("guard"),
        (n if regex_names else escape_regex(n)).alias("body"),
    )


def gram_index(index: DataFrame) -> DataFrame:
    """The names of ``index`` without an anchor, with ``gram``: the rarest run of three characters that every match
    of the pattern holds (null if there is none), counted over all patterns of the index; and ``guard``: its longest
    required part."""
    required = required_text(F.col("body"))
    every = index.select(F.explode(trigrams(required)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    open_ = index.where(F.col("anchor").isNull())
    own = open_.select("body", F.explode(F.array_distinct(trigrams(required))).alias("gram")).distinct()
    best = (own.join(every, "gram").groupBy("body")
               .agg(F.min_by("gram", F.struct("n", "gram")).alias("gram")).withColumnRenamed("body", "__body"))
    longest = longest_run(F.split(required, BREAK))
    return (open_.join(best, F.col("body") == F.col("__body"), "left")
                 .select(*(c for c in index.columns if c != "guard"), longest.alias("guard"), "gram"))


def ends_index(index: DataFrame, payload: list[str]) -> DataFrame:
    """The names of ``index`` that are patterns of whole words (``phrase_ends``): body, the characters ``lead`` and
    ``tail`` at its ends, how many of them (``n_lead``, ``n_tail``) are hashed to ``anchor``, its number of
    words (``n_words``), and ``nth``, which tells rows with the same pattern apart."""
    body = F.col("body")
    lead, tail, n_words = phrase_ends(body, required_text(body))
    ends = index.where(body.rlike(_META_NOT_DOT)).select(*payload, "body", lead.alias("lead"), tail.alias("tail"),
                                                         n_words.alias("n_words"))
    ends = ends.where(F.col("n_words") <= MAX_WINDOW).select(
        "*", F.least(F.length("lead"), F.lit(END_CHARS)).alias("n_lead"),
        F.least(F.length("tail"), F.lit(END_CHARS)).alias("n_tail"))
    return ends.select("*", ends_key(F.col("lead"), F.col("tail"), F.col("n_lead"), F.col("n_tail")).alias("anchor"),
                       F.row_number().over(Window.partitionBy("body").orderBy(*payload)).alias("nth"))


def ends_key(lead: Column, tail: Column, n_lead: Column, n_tail: Column) -> Column:
    """Hash of the first characters of ``lead`` and the last of ``tail``; equal keys are compared again."""
    return F.xxhash64(F.left(lead, n_lead), F.right(tail, n_tail))


def boundary(body: Column) -> Column:
    """``\\b body \\b`` with Python's boundary semantics (see ``functions.words``)."""
    return F.concat(F.lit(BOUNDARY), body, F.lit(BOUNDARY))


def _row_bytes(df: DataFrame) -> Column:
    """Rough size of a row: bytes of its strings plus 8 per other field."""
    parts = [F.coalesce(F.octet_length(f.name), F.lit(0)) if isinstance(f.dataType, T.StringType) else F.lit(8)
             for f in df.schema.fields]
    return sum(parts[1:], parts[0]) if parts else F.lit(0)


def fits_broadcast(df: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> bool:
    """True when ``df`` is proven small: at most ``max_rows`` rows and about ``max_bytes``.

    One job over at most ``max_rows + 1`` rows, so the check stays cheap on a large input.
    """
    max_rows = MAX_BROADCAST_NAMES if max_rows is None else max_rows
    max_bytes = MAX_BROADCAST_BYTES if max_bytes is None else max_bytes
    n, size = df.limit(max_rows + 1).select(_row_bytes(df).alias("b")) \
                .agg(F.count(F.lit(1)), F.sum("b")).collect()[0]
    return n <= max_rows and (size or 0) <= max_bytes


def broadcast_if_bounded(df: DataFrame, max_rows: int | None = None,
                         max_bytes: int | None = None) -> DataFrame:
    """Broadcast hint only behind a proven size bound; otherwise leave the join to the
    planner (sort-merge on the key, AQE splits skewed keys, a runtime bloom filter
    trims the large side before its shuffle)."""
    return F.broadcast(df) if fits_broadcast(df, max_rows, max_bytes) else df


def collect_bounded(df: DataFrame, max_rows: int | None = None) -> list | None:
    """Rows of a small table, or None when it exceeds the bound."""
    max_rows = MAX_LITERAL_NAMES if max_rows is None else max_rows
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def literal_array(rows: list, schema: T.StructType) -> Column:
    """An array<struct> literal holding ``rows`` (already bounded by the caller)."""
    typ = T.ArrayType(schema)
    if not rows:
        return F.array().cast(typ)
    structs = []
    for r in rows:
        structs.append(F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name)
                                  for f in schema.fields]))
    return F.array(*structs).cast(typ)
