"""Pieces of very long texts, so that one document is matched by many tasks.

A text is cut behind every ``size`` characters and the word that goes on there, so the character
after a piece is never a word character. Each piece is led by the last ``overlap`` characters of
the one before it. With ``overlap`` one more than the longest name, every name that
stands at word boundaries in the text stands whole in some piece, with the characters on both
sides of it:

* a name that ends in a piece begins in it or in its lead, behind the lead's first character;
* a piece ends at a word boundary of the text, or between two marks, where no name may end
  that needs a word character next.

And a piece holds no name that the text doesn't: a lead that begins inside a word could show the
rest of that word as a name, so a run of underscores longer than any name is put in
front of it, which makes one word of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toponymic.functions.words import WORD_CLASS

#: Names of the columns added by ``exploded_pieces``: the row of the text, and the piece's place in it.
ROW, PLACE = "__row", "__place"


def _pieces(cut: Column, overlap: int) -> Column:
    """The cut parts of a text, each but the first with its lead."""
    def led(part: Column, i: Column) -> Column:
        lead = F.right(F.get(cut, i - 1), F.lit(overlap))
        fill = F.when(lead.rlike(f"^[{WORD_CLASS}]"), F.lit("_" * overlap)).otherwise(F.lit(""))
        return F.when(i == 0, part).otherwise(F.concat(fill, lead, part))

    return F.transform(cut, led)


def exploded_pieces(docs: DataFrame, text_col: str, size: int, overlap: int) -> DataFrame:
    """``docs`` with one row per piece of its texts, dealt out over the tasks.

    The column ``text_col`` holds the piece, ``ROW`` tells the texts apart (rows with the same key or
    none are texts of their own) and ``PLACE`` orders the pieces. A text without characters, or
    none, has no row.
    """
    if size < overlap:
        raise ValueError("pieces must be at least as long as their overlap")
    rest = [c for c in docs.columns if c != text_col]
    cut = F.regexp_extract_all(F.col(text_col), F.lit(rf"(?s).{{{size}}}[{WORD_CLASS}]*+|.+"), 0)
    parts = docs.select(*rest, F.monotonically_increasing_id().alias(ROW), cut.alias("__cut"))
    return (parts.select(*rest, ROW, F.posexplode(_pieces(F.col("__cut"), overlap)).alias(PLACE, text_col))
                 .repartition(F.col(ROW), F.col(PLACE)))
