"""SimHash near-duplicates through an inverted index of fingerprint bytes.

A fingerprint bit is 1 when it is set in over half of the hashes of a text's word
shingles. Two fingerprints that differ in ``d`` bits share at least ``8 - d`` of their
eight positional bytes: this is the guaranteed minimum of matches. A posting list holds
the distinct fingerprints that share one choice of ``8 - d`` positional bytes, so any two
that can reach the minimum meet in a list, and no list needs a cap: its members differ in
``d`` bytes only. Inside a list the shared positional bytes of each pair are tallied,
pairs that reach the minimum are kept, and their bit distance is verified; a list too
long for comparing its pairs looks up, for each member, the values at up to ``d`` flipped
bits instead. Each list gives a spanning forest of its links, never all its pairs, and
the components of these links are found by label propagation with pointer jumping.

Equal fingerprints are one node (copies are never paired). Defined cases: a null text and
a text without words have fingerprint zero, which links like any other; texts of fewer
words than a shingle are one shingle; rows with a null id take part, and a component of
only such rows has a null id; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toponymic.llm import frames, storage, texts

WORDS = 3
BITS = 2
SEED = 42
#: Shingle hashes whose bits are added up at once.
TALLIED = 1 << 16
#: Lists up to this length compare their pairs; longer ones look up flipped bits. Both give the same links.
PAIRED = 128

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def simhashes(items: list[bytes], size: int = WORDS) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    out = np.zeros(len(items), dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for lo, hi in texts.chunks([len(t) for t in items]):
        # words with one blank between them, so that a shingle is a slice
        lines = [b" ".join(t.translate(_LOWER).split()) for t in items[lo:hi]]
        total, sizes = np.zeros((hi - lo, 64), dtype=np.int64), np.zeros(hi - lo, dtype=np.int64)
        hashes: list[int] = []
        owners: list[tuple[int, int]] = []

        def tally() -> None:
            """Adds up the bits of the hashes gathered so far, and lets go of them."""
            if hashes:
                bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
                own, n = np.array(owners).T
                total[own] += np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int64)
                hashes.clear(), owners.clear()

        for i, line in enumerate(lines):
            if not line:
                continue
            blanks = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)
            starts, ends = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(line)]])
            if len(starts) <= size:
                starts, ends = starts[:1], ends[-1:]
            else:
                starts, ends = starts[:len(starts) - size + 1], ends[size - 1:]
            sizes[i] = len(starts)
            for at in range(0, len(starts), TALLIED):
                some = [digest(line[x:y], SEED) for x, y in zip(starts[at:at + TALLIED].tolist(), ends[at:at + TALLIED].tolist())]
                hashes += some
                owners.append((i, len(some)))
                if len(hashes) >= TALLIED:
                    tally()
        tally()
        ones = total * 2 > sizes[:, None]
        out[lo:hi] = np.packbits(ones, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS) -> DataFrame:
    """``id_col`` and ``fp`` (the 64 bits as a signed long) of every row; map-only."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.small(batches, 1):
            found = simhashes(texts.utf8(batch.column(1)), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---------------------------------------------------------------- the index

def _masks(bits: int) -> list[int]:
    """Byte masks, one for each choice of ``8 - bits`` of the eight positions."""
    return [sum(0xFF << 8 * p for p in kept) for kept in combinations(range(8), 8 - bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def postings(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """The lists with two members or more: ``fps`` (distinct fingerprints that share the
    list's positional bytes; at most ``256 ** bits`` of them)."""
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("choice"),
                              F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("shared"))
                     for i, m in enumerate(_masks(bits))])
    return (nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.choice", "k.shared")
            .groupBy("choice", "shared").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
            .select("fps"))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _by_pairs(v: np.ndarray, bits: int) -> np.ndarray:
    """For each member the place of one that stands for all that its links reach."""
    differ = v[:, None] ^ v[None, :]
    tally = 8 - sum(((differ >> np.uint64(8 * p)) & np.uint64(255) != 0).astype(np.int8) for p in range(8))
    linked = tally >= 8 - bits                               # the count filter
    linked[linked] = _popcount(differ[linked]) <= bits       # verified
    label = np.arange(len(v))
    while True:
        new = np.where(linked, label[None, :], len(v)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def _by_flips(v: np.ndarray, bits: int) -> np.ndarray:
    """The same for a long list: its members differ in the free bytes only, so each looks
    up the values at 1 to ``bits`` flipped bits of those bytes."""
    order = np.argsort(v)
    rising = v[order]
    free = int(np.bitwise_or.reduce(v ^ v[0]))
    places = [b for b in range(64) if free >> b & 1]
    neighbours = []
    for n in range(1, bits + 1):
        for flip in combinations(places, n):
            want = rising ^ np.uint64(sum(1 << b for b in flip))
            at = np.searchsorted(rising, want)
            at[at == len(rising)] = 0
            a = np.flatnonzero(rising[at] == want)
            if len(a):
                neighbours.append((a, at[a]))
    label = np.arange(len(v))
    while True:
        new = label.copy()
        for a, b in neighbours:
            new[a] = np.minimum(new[a], new[b])
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.empty_like(label)
    out[order] = order[label]
    return out


def _forest(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            lists = batch.column(0)
            values, offsets = np.asarray(lists.flatten()), np.asarray(lists.offsets)
            offsets = offsets - offsets[0]
            for lo, hi in zip(offsets, offsets[1:]):
                v = values[lo:hi].view(np.uint64)
                if len(v) == 2:
                    if bin(int(v[0]) ^ int(v[1])).count("1") <= bits:
                        a.append(int(values[lo + 1])), b.append(int(values[lo]))
                    continue
                label = _by_pairs(v, bits) if len(v) <= PAIRED else _by_flips(v, bits)
                for i in np.flatnonzero(label != np.arange(len(v))).tolist():
                    a.append(int(values[lo + i])), b.append(int(values[lo + label[i]]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints at ``bits`` differing bits or fewer:
    a spanning forest of each list, which joins exactly what all links join."""
    return postings(nodes, bits).mapInArrow(_forest(bits), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``fp``, ``label`` for every node with a link: the smallest fingerprint (as a signed number)
    that its links reach, which names the component.

    Each round takes the least label among a node and its neighbours, then jumps to the
    label's own label. Every round is written, so a lost
    executor costs no more than a round.
    """
    both = storage.written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    state = storage.written(both.groupBy(F.col("a").alias("fp")).agg(F.min("b").alias("m"))
                            .select("fp", F.least("fp", "m").alias("label")), "labels")
    while True:
        seen = state.select(F.col("fp").alias("b"), F.col("label").alias("seen"))
        least = both.join(seen, "b").groupBy(F.col("a").alias("fp")).agg(F.min("seen").alias("seen"))
        hooked = state.join(least, "fp").select("fp", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        jump = state.select(F.col("fp").alias("label"), F.col("label").alias("next"))
        new = storage.written(hooked.join(jump, "label").select("fp", "old", F.least("label", "next").alias("label")),
                              "labels")
        if new.where("label <> old").isEmpty():
            break
        state = new.select("fp", "label")
    return state


def _labelled(marked: DataFrame, id_col: str, bits: int) -> DataFrame:
    """``fp``, ``id`` (smallest of its rows), ``label`` of each distinct fingerprint."""
    nodes = storage.written(marked.groupBy("fp").agg(F.min(id_col).alias("id")), "nodes")
    linked = components(links(nodes.select("fp"), bits))
    return nodes.join(linked, "fp", "left").select("fp", "id", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    size: int = WORDS, bits: int = BITS) -> DataFrame:
    """``id_col``, ``fp`` and ``component_id`` (smallest ``id_col`` that links reach) of every row."""
    marked = storage.written(fingerprints(docs, id_col, text_col, size), "simhash")
    nodes = storage.written(_labelled(marked, id_col, bits), "components")
    least = nodes.groupBy("label").agg(F.min("id").alias("component_id"))
    # written, so that both sides of the join are plain shuffles, which Spark splits where a
    # fingerprint is shared by many documents
    named = storage.written(nodes.join(least, "label").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select(id_col, "fp", "component_id")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                            size: int = WORDS, bits: int = BITS) -> DataFrame:
    """One row of ``docs``, with its columns, of each component: the one of the smallest id
    (nulls last), then of the smallest fingerprint; any one of rows equal in both.

    Texts are shuffled once, on the pair of id and fingerprint, so copies are no hot key.
    """
    marked = storage.written(fingerprints(docs, id_col, text_col, size), "simhash")
    none = F.col("id").isNull()
    kept = (_labelled(marked, id_col, bits).groupBy("label").agg(F.min(F.struct(none.alias("none"), "id", "fp")).alias("kept"))
            .select("kept.none", "kept.id", "kept.fp"))
    fp, null = frames.fresh(docs, "__fp"), frames.fresh(docs, "__null")
    own = frames.fresh(docs, "__id")
    kept = storage.written(kept.select(F.col("fp").alias(fp), F.col("none").alias(null),
                                       F.coalesce("id", F.lit(0)).alias(own)), "kept")
    rows = frames.with_columns(docs, text_col, [T.StructField(fp, T.LongType())],
                               lambda column: [pa.array(simhashes(texts.utf8(column), size).view(np.int64))])
    rows = rows.withColumns({null: F.col(id_col).isNull(), own: F.coalesce(F.col(id_col), F.lit(0))})
    return (rows.join(kept.hint("merge"), [fp, null, own], "left_semi").dropDuplicates([fp, null, own])
            .select(*docs.columns))
