"""Token-level matchers: exact noun tokens (J6, F2) and token n-grams.

Both stay on the document row until the final explode, then meet the (size-checked,
broadcast) name table in a hash join; nothing is shuffled on the corpus side.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toponymic.functions.text import token_array
from toponymic.operators.candidates import tag_tokens, token_arrays, tokens_long
from toponymic.operators.match import PLACE_COLS, Gazetteer
from toponymic.operators.names import broadcast_if_bounded


def noun_names(places: DataFrame, lexicon=None) -> DataFrame:
    """Distinct gazetteer names whose tag starts with ``NN``, with that tag. A token's tag
    depends on its text only, so the noun test runs once per name, on the small side.

    Sized once, here, and hinted for broadcast if that allows. Persisted: besides saving the recomputation, a cached relation exposes no
    constraints, so the optimizer does not copy the tag test back onto every corpus
    token through the join key.
    """
    names = places.select(F.col("name").alias("token")).where(F.col("token").isNotNull()).distinct()
    return broadcast_if_bounded(tag_tokens(names, lexicon)
                                .where(F.col("tag").startswith("NN"))
                                .persist(StorageLevel.MEMORY_AND_DISK))


def exact_token_matches(docs: DataFrame, nouns: DataFrame, text_col: str = "text") -> DataFrame:
    """Noun tokens (tag starts with ``NN``) equal to any gazetteer name, exactly.

    ``nouns`` comes from ``noun_names``. Not country-gated; one row per token occurrence
    (doc_id, pos, token, tag), so a repeated name is reported each time, in token order
    by ``pos``. The corpus side is a plain hash probe against the broadcast nouns.
    """
    tok = token_arrays(docs, text_col, strip=False)
    return (tokens_long(tok, with_tags=False).join(nouns, "token")
                                              .select("doc_id", "pos", "token", "tag"))


def ngram_names(places: DataFrame, max_n: int) -> DataFrame:
    """Names an n-gram can equal: at most ``max_n`` tokens, and the name is its own
    tokens joined by one space. Adds ``first`` (its first token) and ``n``."""
    ntoks = token_array(F.col("name"))
    return (places.select(*PLACE_COLS, ntoks.alias("__ntoks"))
                  .where(F.size("__ntoks").between(1, max_n)
                         & (F.array_join("__ntoks", " ") == F.col("name")))
                  .select(*PLACE_COLS, F.get(F.col("__ntoks"), 0).alias("first"),
                          F.size("__ntoks").alias("n")))


def ngram_matches(docs: DataFrame, gaz: Gazetteer, text_col: str = "text", max_n: int = 3,
                  gate: bool = True) -> DataFrame:
    """Token n-grams (n <= ``max_n``, tokens joined by one space) equal to a place name,
    country gate kept. One row per (doc_id, pos, n, place row).

    Equivalent to generating every n-gram and joining it with the names, but only the
    positions whose token starts some name are looked at: each token position joins the
    names on their first token (broadcast hash join), and the following ``n - 1`` tokens
    are compared for those hits only. A position carries the ``max_n`` tokens from it on,
    never the document's token array, so a shuffle on the token stays narrow; documents
    without any country are not exploded.
    """
    units = gaz.text_units(docs, text_col)
    gate_cols = [c for c in ["isos"] if c in units.columns]
    toks = units.select("doc_id", *gate_cols, token_array(F.col("text")).alias("toks"))
    worth = F.when(F.size("isos") > 0, F.col("toks")) if gate and gate_cols else F.col("toks")
    at = toks.select("doc_id", *gate_cols, "toks", F.posexplode_outer(worth).alias("pos", "tok"))
    gram = F.array(*[F.get(F.col("toks"), F.col("pos") + k) for k in range(max_n)])
    at = at.select("doc_id", *gate_cols, "pos", "tok", gram.alias("gram"))
    names = gaz.prepared(("ngram_names", max_n), lambda: broadcast_if_bounded(ngram_names(gaz.places, max_n)))
    hits = (at.join(names, F.col("tok") == F.col("first"))
              .where(F.array_join(F.slice("gram", 1, F.col("n")), " ") == F.col("name")))
    cols = ["doc_id", F.col("pos").cast("long").alias("pos"), F.col("n").alias("n"), *PLACE_COLS]
    if not gate:
        return hits.select(*cols)
    if gate_cols:
        return hits.where(F.array_contains("isos", F.col("countrycode"))).select(*cols)
    found = gaz.countries_in(units).withColumnRenamed("doc_id", "__doc")
    return (hits.join(found, (hits.doc_id == found["__doc"]) & (hits.countrycode == found.iso), "left_semi")
                .select(*cols))
