"""Language by rank-order profiles of character n-grams.

A profile is the list of the most frequent n-grams (one to three letters, words padded
with one boundary on both sides), by falling count and then n-gram. A document's profile
is compared with each language's: for each of its n-grams the difference of the two
ranks, or the profile length where the language lacks it, adds to the out-of-place
distance, and the language with the smallest distance is predicted (the first by name on
a tie). Only letters count, in lower case.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and so is
every text if no labelled row could be learned from; equal texts get equal results. The
score is one less the distance over the largest possible one.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from toponymic.llm import texts

PROFILE = 400
#: Score below which a text counts as written in none of the learned languages.
LEAST = 0.2
UNKNOWN = "und"
_EDGE = 1       # a code point that is no letter, for the boundary of a word
_BOUNDARY = np.array([_EDGE], dtype=np.uint32)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    out = np.zeros(0x110000, dtype=bool)
    out[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return out


def _points(text: str) -> np.ndarray:
    """Lower-case code points, each stretch of other characters being one boundary."""
    p = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    p = np.where(_letters()[p], p, np.uint32(_EDGE))
    p = np.concatenate([_BOUNDARY, p, _BOUNDARY])
    keep = np.ones(len(p), dtype=bool)
    keep[1:] = (p[1:] != _EDGE) | (p[:-1] != _EDGE)
    return p[keep]


class Grams:
    """N-grams of several texts as small numbers, under the alphabet of those texts."""

    def __init__(self, items: list[str]):
        points = [_points(t) for t in items]
        used = np.zeros(0x110000, dtype=bool)
        used[_EDGE] = True
        for p in points:
            used[p] = True
        self.alphabet = np.flatnonzero(used).astype(np.uint64)           # the boundary comes first
        self.k = len(self.alphabet)
        code = np.zeros(0x110000, dtype=np.int64)
        code[self.alphabet.astype(np.int64)] = np.arange(self.k)
        self.codes = [code[p] for p in points]

    def of(self, i: int) -> np.ndarray:
        """All n-grams of one text, repeats included: c, k + ab, k + k*k + abc."""
        c, k = self.codes[i], self.k
        ab = c[:-1] * k + c[1:]
        abc = ab[:-1] * k + c[2:]
        return np.concatenate([c[c > 0], k + ab, (k + k * k + abc)[c[1:-1] > 0]])

    def counts(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of one text, as full numbers, and how often it has them."""
        found, n = np.unique(self.of(i), return_counts=True)
        return self.full(found), n

    def full(self, codes: np.ndarray) -> np.ndarray:
        """The n-grams' code points in one number, 21 bits each, whatever the alphabet."""
        k, a = self.k, self.alphabet
        out = np.zeros(len(codes), dtype=np.uint64)
        one, three = codes < k, codes >= k + k * k
        two = ~one & ~three
        out[one] = a[codes[one]]
        x = codes[two] - k
        out[two] = a[x // k] << np.uint64(21) | a[x % k]
        x = codes[three] - k - k * k
        out[three] = a[x // (k * k)] << np.uint64(42) | a[x // k % k] << np.uint64(21) | a[x % k]
        return out


def counted(items: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct n-grams and counts of each text. A very long text is counted in pieces,
    which begin at blanks, so that no n-gram is lost."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for lo, hi in texts.chunks([len(t) for t in items]):
        if hi - lo > 1 or len(items[lo]) <= texts.CHUNK_BYTES:
            grams = Grams(items[lo:hi])
            out += [grams.counts(i) for i in range(hi - lo)]
            continue
        parts = [Grams([p]).counts(0) for p in texts.pieces(items[lo])]
        full, at = np.unique(np.concatenate([f for f, _ in parts]), return_inverse=True)
        n = np.zeros(len(full), dtype=np.int64)
        np.add.at(n, at, np.concatenate([c for _, c in parts]))
        out.append((full, n))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts by language of a task's rows."""
    for batch in texts.small(batches, 1):
        langs, items = batch.column(0).to_pylist(), texts.strings(batch.column(1))
        for lo, hi in texts.chunks([len(t) for t in items]):
            by_lang: dict[str, list[str]] = {}
            for lang, t in zip(langs[lo:hi], items[lo:hi]):
                by_lang.setdefault(lang, []).append(t)
            for lang, group in by_lang.items():
                found, n = counted([" ".join(group)])[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n)],
                    names=["lang", "gram", "n"])


class Profiles:
    """Rank of each n-gram in each language's profile."""

    def __init__(self, ranked: dict[str, list[int]], size: int = PROFILE):
        self.langs, self.size = sorted(ranked), size
        self.grams = np.array(sorted({g for grams in ranked.values() for g in grams}), dtype=np.uint64)
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), -1, dtype=np.int64)   # last: none
        for i, lang in enumerate(self.langs):
            at = np.searchsorted(self.grams, np.array(ranked[lang], dtype=np.uint64))
            self.ranks[i, at] = np.arange(len(ranked[lang]))

    def distances(self, profile: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a document's profile to every language's."""
        if not len(self.grams):
            return np.full(len(self.langs), len(profile) * self.size)
        at = np.searchsorted(self.grams, profile)
        at = np.where((at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] == profile), at, -1)
        ranks = self.ranks[:, at]
        return np.where(ranks >= 0, np.abs(ranks - np.arange(len(profile))), self.size).sum(axis=1)

    def predict(self, items: list[str]) -> list[tuple[str, float]]:
        out = []
        for full, n in counted(items):
            if not self.langs or not len(full):
                out.append((UNKNOWN, 0.0))
                continue
            top = np.lexsort((full, -n))[:self.size]
            d = self.distances(full[top])
            best = int(d.argmin())
            out.append((self.langs[best], float(1 - d[best] / (len(top) * self.size))))
        return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> Profiles:
    """Profiles of all languages from all rows of ``docs`` with a language and a text.

    Counts are summed in the tasks first; what reaches the driver is ``size`` n-grams for
    each language.
    """
    counted = (docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(lang_col, text_col)
               .mapInArrow(_count, "lang string, gram long, n long")
               .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    ranked: dict[str, list[int]] = {}
    for r in counted.withColumn("place", place).where(F.col("place") <= size).orderBy("lang", "place").collect():
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranked, size)


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred``, ``score`` of every row; map-only."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType),
                           T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.small(batches, 1):
            found = profiles.predict(texts.strings(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def known_language(docs: DataFrame, profiles: Profiles, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of ``docs``, with their columns, whose text is in a learned language: not
    ``und``, and with a score of at least ``least``. Map-only."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.small(batches, at):
            found = profiles.predict(texts.strings(batch.column(at)))
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that training must not see: a quarter of them, by the CRC of the id as text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
