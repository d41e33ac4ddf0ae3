"""Entities from a phrase list (X5): leftmost-longest matching of names of several tokens.

The list is read as a trie: a level for each length that its phrases have (and one for the
first token) holds the distinct prefixes of that length, whether a phrase ends there and
whether one goes on. Every position of a document meets the levels one after the other, by
equi-joins on the prefix; only positions whose tokens so far begin some phrase go on, so
after the first level few rows are left. A level is broadcast behind the usual bound, else joined by a
shuffle; positions that are through get keys of their own there, so they are no hot key. The longest phrase of
each start travels, with its tokens, in one exchange on the document, where a scan from
the left keeps each start that the phrase kept before it doesn't cover.

The plan has a join for each length of the list; matched phrases of one document are one row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toponymic.functions.text import coded_pos, strip_parens, token_array
from toponymic.operators.names import fits_broadcast


def phrase_tokens(phrases: DataFrame, col: str = "phrase") -> DataFrame:
    """(t): the distinct token arrays of a phrase list, by the tokenizer of the texts; null phrases and
    phrases without a token are left out."""
    return phrases.select(token_array(strip_parens(col)).alias("t")).where(F.size("t") > 0).distinct()


def _prefix(tokens, k: int):
    return F.array_join(F.slice(tokens, 1, k), "\n")


def _level(table: DataFrame, k: int) -> DataFrame:
    """(prefix, ends, goes_on) of the trie at depth ``k``."""
    return (table.where(F.size("t") >= k).groupBy(_prefix(F.col("t"), k).alias("prefix"))
                 .agg(F.max(F.size("t") == k).alias("ends"), F.max(F.size("t") > k).alias("goes_on")))


def longest_starts(tok: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, pos, phrase): the longest phrase, as tokens, that starts at each position where one starts.
    ``tok``: doc_id and ``tokens``; ``table``: from ``phrase_tokens``."""
    lengths = [r["n"] for r in table.select(F.size("t").alias("n")).distinct().collect()]     # a row per length
    longest = max(lengths, default=1)
    at = tok.select("doc_id", "tokens", F.posexplode("tokens").alias("pos", "token"))
    follow = F.slice("tokens", F.col("pos") + 1, longest).alias("w")
    for k in sorted({1, *lengths}):
        level = _level(table, k)
        small = fits_broadcast(level)
        level = F.broadcast(level) if small else level
        if k == 1:
            if not small:       # a shuffle moves a position with the tokens that follow, never a text's
                at = at.select("doc_id", "pos", "token", follow)
            at = (at.join(level, F.col("token") == F.col("prefix"))
                    .select("doc_id", F.col("pos").cast("long").alias("pos"), follow if small else "w",
                            F.when(F.col("ends"), 1).otherwise(0).alias("n"), "goes_on"))
            continue
        own = F.lit(None).cast("string") if small else F.concat(F.lit("\n"), F.col("pos").cast("string"))   # no prefix begins so
        key = F.when(F.col("goes_on") & (F.size("w") >= k), _prefix(F.col("w"), k)).otherwise(own)
        at = (at.select("doc_id", "pos", "w", "n", key.alias("key"), F.col("goes_on").alias("before"))
                .join(level, F.col("key") == F.col("prefix"), "left")
                .select("doc_id", "pos", "w", F.when(F.col("ends"), k).otherwise(F.col("n")).alias("n"),
                        F.coalesce(F.col("goes_on"), F.lit(False)).alias("goes_on")))
    return at.where(F.col("n") > 0).select("doc_id", "pos", F.expr("slice(w, 1, n)").alias("phrase"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _uncovered(starts: pd.Series, sizes: pd.Series) -> pd.Series:
    """Numbers of the rising starts that the phrase kept before them doesn't cover."""
    out = []
    for begin, size in zip(starts, sizes):
        free, kept = 0, []
        for i, (b, n) in enumerate(zip(begin.tolist(), size.tolist())):
            if b >= free:
                kept.append(i)
                free = b + n
        out.append(kept)
    return pd.Series(out)


def phrase_docs(tok: DataFrame, phrases: DataFrame, col: str = "phrase") -> DataFrame:
    """One row per document with a phrase of the list: doc_id and ``spans`` in the coded form of
    ``operators.candidates.candidate_docs``, one span for each phrase found (neighbours stay apart).

    ``doc_id`` tells documents apart (rows that share one, or have none, are one document whose
    starts are taken in the order of position and tokens). Null texts have no phrase; an empty list or table
    gives no row; repeated phrases count once.
    """
    starts = longest_starts(tok, phrase_tokens(phrases, col))
    # coded before the exchange: a string is sorted and moved for less than an array; its order is that of its tokens
    coded = F.array_join(F.transform("phrase", lambda t, j: F.concat(F.lit("\nP"), coded_pos(F.col("pos") + j), t)), "")
    units = starts.select("doc_id", F.struct("pos", coded.alias("span"), F.size("phrase").alias("n")).alias("u"))
    per_doc = units.groupBy("doc_id").agg(F.array_sort(F.collect_list("u")).alias("u"))
    kept = per_doc.select("doc_id", "u", _uncovered(
        F.transform("u", lambda x: x["pos"]), F.transform("u", lambda x: x["n"])).alias("kept"))
    coded = F.transform("kept", lambda i: F.get("u", i)["span"])
    return kept.select("doc_id", coded.alias("spans"))
