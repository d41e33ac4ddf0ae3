"""Best-fit packing of documents into sequences under conflict constraints.

A document longer than a sequence gives full sequences of its own and one remainder. All
remainders of a shard are placed in falling order of length: the open bins are ordered by
residual, and the search starts at the smallest residual that holds the piece and goes to
the next larger one until a bin is compatible, which is the tightest compatible one. Each
bin carries a bitmap of the sources and one of the duplicate clusters in it; a bin with
the piece's source or cluster is not compatible. If none is, a new bin opens.

Shards are dealt by a hash of the document, about ``SHARD`` pieces each, so their number
grows with the input, a hot source is spread over all of them, and a task holds one
shard's lengths, never texts. Bins of one residual are grouped by their source bitmap,
so a hot source doesn't make the search visit every bin.

Defined cases: a document of length zero, or of null length, has no piece to place and
gives one row with a null ``bin``; a null source or cluster conflicts with nothing; ties in length go by
id, source and cluster; rows that repeat are placed each on its own; an empty table gives
an empty table.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toponymic.llm import bpe, frames, simhash, storage, texts

CAPACITY = 2048
SHARD = 5000

Piece = tuple[int, int | None, int | None]      # length, source bit number, cluster bit number


def best_fit(pieces: list[Piece], capacity: int) -> list[tuple[int, int]]:
    """Bin number and offset of each piece; lengths are 1 to ``capacity``, taken in the
    order given."""
    groups: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]     # residual -> sources -> bins
    held = 0                                                                  # bit r: a bin of residual r is open
    clusters: list[int] = []                                                  # bitmap of each bin
    out = []
    for length, source, cluster in pieces:
        s = 0 if source is None else 1 << source
        c = 0 if cluster is None else 1 << cluster
        found = None
        rest = held >> length << length
        while rest and found is None:                                         # successors, tightest first
            lowest = rest & -rest
            residual = lowest.bit_length() - 1
            for sources, bins in groups[residual].items():
                if sources & s:
                    continue
                at = next((i for i, b in enumerate(bins) if not clusters[b] & c), None)
                if at is not None:
                    found = residual, sources, bins.pop(at)
                    if not bins:
                        del groups[residual][sources]
                        if not groups[residual]:
                            held &= ~lowest
                    break
            rest &= ~lowest
        if found is None:
            found = capacity, 0, len(clusters)
            clusters.append(0)
        residual, sources, b = found
        out.append((b, capacity - residual))
        clusters[b] |= c
        left = residual - length
        if left:
            groups[left].setdefault(sources | s, []).append(b)
            held |= 1 << left
    return out


_OUT = "doc_id long, piece long, piece_start long, piece_length long, bin long, bin_offset long"


def _pack_shard(capacity: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(whole=rows["length"] // capacity, rest=rows["length"] % capacity)
        rows = rows.sort_values(["rest", "doc_id", "source", "cluster"], ascending=[False, True, True, True],
                                na_position="first", kind="stable").reset_index(drop=True)
        some = rows[rows["rest"] > 0]
        bits: dict = {}
        source = [None if pd.isna(x) else bits.setdefault(x, len(bits)) for x in some["source"]]
        often = some["cluster"].value_counts()
        numbered = {x: i for i, x in enumerate(often.index[often > 1])}       # a cluster met once conflicts with nothing
        cluster = [None if pd.isna(x) else numbered.get(x) for x in some["cluster"]]
        placed = best_fit(list(zip(some["rest"].tolist(), source, cluster)), capacity)
        first = key[0] << 32
        ends = pd.DataFrame({
            "doc_id": some["doc_id"], "piece": some["whole"], "piece_start": some["whole"] * capacity,
            "piece_length": some["rest"], "bin": pd.array([first | b for b, _ in placed], "Int64"),
            "bin_offset": pd.array([o for _, o in placed], "Int64")})
        full = rows.loc[rows.index.repeat(rows["whole"])]                     # each alone in a bin of its own
        piece = full.groupby(level=0).cumcount().to_numpy()
        opened = max((b for b, _ in placed), default=-1) + 1
        full = pd.DataFrame({
            "doc_id": full["doc_id"].array, "piece": piece, "piece_start": piece * capacity, "piece_length": capacity,
            "bin": pd.array([first | opened + i for i in range(len(full))], "Int64"), "bin_offset": 0})
        none = rows[rows["length"] == 0]
        none = pd.DataFrame({"doc_id": none["doc_id"], "piece": 0, "piece_start": 0, "piece_length": 0,
                             "bin": pd.array([None] * len(none), "Int64"), "bin_offset": pd.array([None] * len(none), "Int64")})
        return pd.concat([x for x in (ends, full, none) if len(x)], ignore_index=True)

    return run


def words(text: Column) -> Column:
    """Length in words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def with_tokens(docs: DataFrame, path: str, column: str = "n_tokens", text_col: str = "text") -> DataFrame:
    """``docs`` with the number of byte-level BPE ids of the text (the tokenizer file of
    operator 8), as a length for ``pack`` or ``pack_near_copies``."""
    def count(batch: pa.Array) -> list[pa.Array]:
        coder = bpe.coder(path)
        return [pa.array([len(coder.encode(t)) for t in texts.strings(batch)], pa.int64())]

    return frames.with_columns(docs, text_col, [T.StructField(column, T.LongType())], count)


def exact_copies(text: Column) -> Column:
    """Cluster of documents with equal texts up to case and white space (null: no text)."""
    return F.when(text.isNotNull(), F.xxhash64(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " ")))


def pack(docs: DataFrame, length: Column, source: Column, cluster: Column, id_col: str = "doc_id",
         capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """One row for each piece: ``doc_id``, ``piece`` (from 0), its start and length in the
    document, ``bin`` (null for an empty document) and the offset in the bin.

    ``source`` is hashed to 64 bits. The rows are counted first to deal the shards.
    """
    items = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("length"),
        F.when(source.isNotNull(), F.xxhash64(source)).alias("source"), cluster.cast("long").alias("cluster"))
    return pack_items(items, capacity, shard)


def pack_near_copies(docs: DataFrame, length: Column, source: Column, id_col: str = "doc_id", text_col: str = "text",
                     capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """``pack`` with the near-duplicate component of the text as the cluster (null: no text).

    The components are those of operator 5 over texts in lower case with single blanks, so
    copies equal up to case and white space are always of one cluster. Rows are joined to
    their component by the fingerprint, never by ``doc_id``; texts are read once.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("length"),
        F.when(source.isNotNull(), F.xxhash64(source)).alias("source"), text.isNotNull().alias("is_text"),
        F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " ").alias("text"))
    marked = storage.written(
        frames.with_columns(rows, "text", [T.StructField("fp", T.LongType())],
                            lambda column: [pa.array(simhash.simhashes(texts.utf8(column)).view("int64"))]).drop("text"), "lengths")
    labels = storage.written(simhash._labelled(marked, "doc_id", simhash.BITS).select("fp", "label"), "clusters")
    items = marked.join(labels, "fp").select("doc_id", "length", "source", F.when(F.col("is_text"), F.col("label")).alias("cluster"))
    return pack_items(storage.written(items, "items"), capacity, shard)


def pack_items(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """``pack`` for a table of ``doc_id, length, source, cluster`` (longs)."""
    shards = max(1, -(-items.count() // shard))
    own = F.pmod(F.xxhash64("doc_id", "length", "source", "cluster"), F.lit(shards))
    return items.withColumn("shard", own).groupBy("shard").applyInPandas(_pack_shard(capacity), _OUT)
