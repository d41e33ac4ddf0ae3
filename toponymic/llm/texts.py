"""Vectorised text helpers used inside Arrow batches: chunking, word offsets, hashes.

A word is a maximal run of bytes other than blank, tab, line feed, vertical tab, form
feed and carriage return. All of those are single bytes in UTF-8, so the byte offsets
found here never cut a character.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled by one round of array operations; a longer text is a round alone.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)      # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def strings(column: pa.Array) -> list[str]:
    """Values of a string column; null counts as the empty text."""
    return [x if x is not None else "" for x in column.to_pylist()]


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as the empty text."""
    return [x if x is not None else b"" for x in column.cast(pa.large_binary()).to_pylist()]


class Cache:
    """A bounded cache in two generations: when the young one is full it becomes the old
    one, and what is used again moves back, so frequent entries stay."""

    def __init__(self, size: int):
        self.size, self.young, self.old = max(1, size // 2), {}, {}

    def get(self, key):
        """For keys that ``young`` lacks: the value from the old generation, or None."""
        found = self.old.get(key)
        if found is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old = dict(self.young)
            self.young.clear()          # stays the same object, so a reader may hold its get
        self.young[key] = value


def chunks(lengths: list[int], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose lengths add up to ``most`` at most, or single items."""
    lo = total = 0
    for i, n in enumerate(lengths):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(lengths):
        yield lo, len(lengths)


def small(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 * CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of text (or one row), so that a worker's memory
    doesn't follow the number of rows that Spark puts in a batch."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for lo, hi in chunks(lengths, most):
            yield batch.slice(lo, hi - lo)


def pieces(text: str, most: int | None = None) -> Iterator[str]:
    """A text in pieces of about ``most`` characters, each but the first beginning with a blank
    (a stretch without any blank stays whole), so that a very long text needs no more memory."""
    most = CHUNK_BYTES if most is None else most
    at = 0
    while at < len(text):
        end = text.find(" ", at + most) if len(text) - at > most else -1
        yield text if not at and end < 0 else text[at:end if end >= 0 else None]
        if end < 0:
            return
        at = end


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
#: Bytes of a word from which on it is hashed alone, and of the text hashed at once.
_LONG_WORD, _STRETCH = 1 << 16, 1 << 20


@functools.lru_cache(maxsize=2)
def _powers(base: int) -> np.ndarray:
    out = np.full(_STRETCH + _LONG_WORD, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """Word offsets of several texts laid end to end with line feeds between them.

    ``data``: the bytes; ``starts``/``ends``: byte range of each word; ``first``: for each
    text the number of its first word, with the total at the end.
    """

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8)
        space = SPACE[self.data]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.offsets = np.cumsum([1] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.starts, self.offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word, the same wherever the word stands. The text is taken
        in stretches, so a very long one needs no more memory."""
        starts, ends = self.starts, self.ends
        out = np.empty(len(starts), dtype=np.uint64)
        long = np.flatnonzero(ends - starts > _LONG_WORD)
        for i in long.tolist():
            out[i] = xxhash.xxh64_intdigest(self.data[starts[i]:ends[i]].tobytes())
        power, inverse = _powers(int(_BASE)), _powers(int(_INVERSE))
        lo = 0
        for stop in [*long.tolist(), len(starts)]:
            while lo < stop:
                hi = min(stop, max(lo + 1, int(np.searchsorted(starts, starts[lo] + _STRETCH))))
                a, b = starts[lo], ends[hi - 1]
                total = np.zeros(b - a + 1, dtype=np.uint64)
                np.cumsum(_VALUES[self.data[a:b]] * power[:b - a], out=total[1:])
                begin = starts[lo:hi] - a
                out[lo:hi] = mix((total[ends[lo:hi] - a] - total[begin]) * inverse[begin])
                lo = hi
            lo = stop + 1
        return out

    def sums(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text ``mask`` marks."""
        begin, end = self.offsets[:-1], self.offsets[1:] - 1
        found = np.add.reduceat(mask, np.stack([begin, end], axis=1).ravel(), dtype=np.int64)[::2] if len(begin) else begin
        return np.where(end > begin, found, 0)

    def inside(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each word ``mask`` marks."""
        if not len(self.starts):
            return self.starts
        return np.add.reduceat(mask, np.stack([self.starts, self.ends], axis=1).ravel(), dtype=np.int64)[::2]


def shingles(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size``-word shingles and the number of the text each belongs to, in text
    order, repeats included. A text of fewer words is one shingle, one of none has none."""
    counts = words.counts()
    owner = np.repeat(np.arange(len(counts)), counts)
    n = len(hashes) - size + 1
    found, texts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n > 0:
        all_ = np.zeros(n, dtype=np.uint64)
        for j in range(size):
            all_ = all_ * _STEP + hashes[j:j + n]
        whole = owner[:n] == owner[size - 1:]
        found, texts = mix(all_[whole]), owner[:n][whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        for j in range(size - 1):
            has = counts[short] > j
            at = words.first[short[has]] + j
            extra[has] = extra[has] * _STEP + hashes[at]
        found, texts = np.concatenate([found, mix(extra)]), np.concatenate([texts, short])
        order = np.argsort(texts, kind="stable")
        found, texts = found[order], texts[order]
    return found, texts
