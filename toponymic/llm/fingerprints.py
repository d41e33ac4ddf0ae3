"""Threshold-scaled sketches of documents.

A document's sketch holds every five-word shingle hash below ``2**64 / scale``, plus its
``few`` smallest hashes, so a short text's sketch is all of its shingles. Sketches merge: the
union's sketch is the union of both, cut to the threshold and its ``few`` smallest hashes.
A sketch alone tells up to which hash it is complete (``known_up_to``): the threshold, or
its last hash where that is higher, or any hash if it has fewer than ``few``. Two sketches are
compared up to the lower of both limits, so the estimates need nothing but the sketches, made or
read back, however unequal the texts.

Defined cases: a null text is the empty text; a text of fewer than five words is one
shingle; a text without words has an empty sketch, which equals another empty one
(likeness 1) and has likeness 0 to any other. Equal texts have equal sketches. Likeness is
always known; containment is None, unknown, if the first sketch has no hash up to
the limit (a short text beside a long one). An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toponymic.llm import ranges, texts

SCALE = 4
WORDS = 5
FEW = 16


def _threshold(scale: int) -> np.uint64:
    """The highest hash that is kept."""
    return np.uint64((1 << 64) // scale - 1)


def _distinct(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's hashes once, rising."""
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    return hashes[new], docs[new]


def sketches(items: list[bytes], scale: int = SCALE, size: int = WORDS, few: int = FEW) -> list[np.ndarray]:
    """The sketch of each text: rising, distinct 64-bit hashes."""
    out: list[np.ndarray] = []
    below = _threshold(scale)
    for lo, hi in texts.chunks([len(t) for t in items]):
        words = texts.Words(items[lo:hi])
        found, owner = texts.shingles(words, words.hashes(), size)
        kept = found <= below
        hashes, docs = _distinct(found[kept], owner[kept])
        n = np.bincount(docs, minlength=hi - lo)
        more = ~kept & (n[owner] < few)                      # above the threshold, in texts that have few below
        high, of = _distinct(found[more], owner[more])
        rank = np.arange(len(of)) - np.searchsorted(of, of) + n[of]
        hashes, docs = np.concatenate([hashes, high[rank < few]]), np.concatenate([docs, of[rank < few]])
        hashes = hashes[np.argsort(docs, kind="stable")]
        cut = np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=hi - lo))])
        out += [hashes[cut[i]:cut[i + 1]] for i in range(hi - lo)]
    return out


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE, few: int = FEW) -> np.ndarray:
    """The sketch of two documents' shingles taken together."""
    both = np.union1d(a, b)
    return both[(both <= _threshold(scale)) | (np.arange(len(both)) < few)]


def known_up_to(sketch: np.ndarray, scale: int = SCALE, few: int = FEW) -> np.uint64:
    """The highest hash up to which a sketch holds every hash of its document."""
    if len(sketch) < few:
        return np.uint64((1 << 64) - 1)
    return max(_threshold(scale), sketch[-1])


def _compared(a: np.ndarray, b: np.ndarray, scale: int, few: int) -> tuple[int, int, int]:
    """How many hashes each side has up to the lower limit, and how many both have."""
    top = min(known_up_to(a, scale, few), known_up_to(b, scale, few))
    a, b = (x[:np.searchsorted(x, top, side="right")] for x in (a, b))
    return len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))


def likeness(a: np.ndarray, b: np.ndarray, scale: int = SCALE, few: int = FEW) -> float:
    """Estimated share of common shingles among all shingles of both (0 to 1)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    n, m, common = _compared(a, b, scale, few)
    return common / (n + m - common)


def containment(a: np.ndarray, b: np.ndarray, scale: int = SCALE, few: int = FEW) -> float | None:
    """Estimated share of the first document's shingles that the second has (0 to 1)."""
    if not len(a) or not len(b):
        return float(not len(a))
    n, _, common = _compared(a, b, scale, few)
    return common / n if n else None


def as_text(sketch: np.ndarray) -> str:
    """16 hexadecimal digits for each hash, rising."""
    return sketch.astype(">u8").tobytes().hex()


def of_text(text: str) -> np.ndarray:
    """The sketch that ``as_text`` wrote."""
    return np.frombuffer(bytes.fromhex(text), dtype=">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 scale: int = SCALE, size: int = WORDS) -> DataFrame:
    """``id_col``, ``fingerprint`` (sketch as hexadecimal text) of every row, map-only."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.small(batches, 1):
            found = sketches(texts.utf8(batch.column(1)), scale, size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([as_text(s) for s in found], pa.string())],
                names=[id_col, "fingerprint"])

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("fingerprint", T.StringType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


# ---------------------------------------------------------------- edited copies

_EDITED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()),
    T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()),
    T.StructField("near_next", T.DoubleType()), T.StructField("contained_edited", T.DoubleType()),
    T.StructField("contained_next", T.DoubleType())])


def _with_followers(docs: DataFrame) -> DataFrame:
    """Rows in descending order of ``doc_id`` within ranges, each range closed by the first
    row of the next one (flagged), the last by the first row of all. Rows of one
    ``doc_id`` follow each other by text, null ids come last."""
    n = ranges.ranges(docs)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    cuts = ranges.bounds(ids, "doc_id", n)
    tops = {r["p"]: r["top"] for r in ids.groupBy(ranges.range_of(F.col("doc_id"), cuts).alias("p"))
            .agg(F.max("doc_id").alias("top")).collect()}                 # a row per range
    held = sorted(tops, reverse=True)
    before = {p: held[i - 1] for i, p in enumerate(held)}                 # the range before, in a ring
    marks = np.array(cuts, dtype=np.int64)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def targets(ids: pd.Series) -> pd.Series:
        out = []
        for x in ids.tolist():
            null = x is None or x != x
            p = 0 if null else int(np.searchsorted(marks, int(x), side="right"))
            top = tops[p]
            first = null if top is None else not null and int(x) == top
            out.append([p, before[p]] if first else [p])
        return pd.Series(out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.posexplode(targets(F.col("doc_id"))).alias("__ctx", ranges.PART))
    return (rows.repartitionById(len(cuts) + 1, F.col(ranges.PART))
            .sortWithinPartitions(ranges.PART, "__ctx", F.desc_nulls_last("doc_id"), "text"))


def _compare(scale: int, size: int):
    def rows(ids: list, items: list[str], own: list[bool]) -> pa.RecordBatch:
        """Output for each row but the last, whose follower is not known yet."""
        edited = []
        for t, nxt in zip(items, items[1:]):
            k = len(t) // 3
            edited.append((t[:len(t) - k] + nxt[:k]).encode("utf-8", "surrogatepass"))
        plain = sketches([t.encode("utf-8", "surrogatepass") for t in items], scale, size)
        other = sketches(edited, scale, size)
        at = [i for i in range(len(edited)) if own[i]]
        columns = [
            [ids[i] for i in at], [len(items[i]) for i in at],
            [hashlib.sha256(edited[i]).hexdigest() for i in at],
            [as_text(plain[i]) for i in at], [as_text(other[i]) for i in at],
            [likeness(plain[i], other[i], scale) for i in at], [likeness(plain[i], plain[i + 1], scale) for i in at],
            [containment(plain[i], other[i], scale) for i in at],
            [containment(plain[i], plain[i + 1], scale) for i in at]]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()] + [pa.float64()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_EDITED.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, items, own = [], [], []
        for batch in texts.small(batches, 1):
            ids += batch.column(0).to_pylist()
            items += batch.column(1).to_pylist()
            own += [c == 0 for c in batch.column(2).to_pylist()]
            if len(items) > 1:
                yield rows(ids, items, own)
                ids, items, own = ids[-1:], items[-1:], own[-1:]

    return run


def edited_copies(docs: DataFrame, scale: int = SCALE, size: int = WORDS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text is the text with its last third (rounded down, in code points)
    replaced by as many first code points of the next document in descending order of
    ``doc_id``, in a ring. The rows are range-partitioned once by ``doc_id``; each task
    then meets its rows in order, so texts are shuffled once and no window spans tasks.
    ``doc_id`` is taken as an identifier: rows that share one stay together.
    """
    rows = _with_followers(docs).select("doc_id", "text", "__ctx")
    return rows.mapInArrow(_compare(scale, size), _EDITED)
