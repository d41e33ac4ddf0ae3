"""Byte-level BPE: encoding with a priority queue of merges, decoding by concatenation.

The text is cut by the published pre-tokenising pattern. The bytes of a piece form a
doubly linked list of symbols; a heap holds each neighbouring pair that the merge table
knows, by rank and then position. The best entry is popped; one whose pair has changed
since it was pushed is stale and skipped; else the pair becomes one symbol and its two
new neighbour pairs are pushed. Decoding concatenates the bytes of the vocabulary strings
and reads them as UTF-8, with replacement marks where they are not.

Defined cases: a null text is the empty text and has no ids; strings of special tokens
inside a text become their ids; an unknown id raises KeyError. A text of any length is
encoded whole; the caches are bounded.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toponymic.llm import texts

#: The published pattern that cuts a text before any merge (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries kept of each of the two caches of a worker. Results don't depend on it.
CACHE = 700_000
#: White space beside a blank that separates two words; such texts are cut by the pattern as a whole.
_ODD = re.compile(r"[^\S \n]| [ \n]|\n |\x85")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Coder:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        back = {c: b for b, c in symbols.items()}
        self.strings = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.byte_id = [vocab[symbols[b]] for b in range(256)]
        self.merges: dict[int, int] = {}                    # pair of ids -> rank and new id
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
        self.find_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) \
            if self.special else None
        self.cut, self.cut_each = regex.compile(PATTERN).findall, regex.compile(PATTERN).finditer
        self.same = list(range(max(self.strings) + 1))      # one object for each id, so that caches share them
        self.pieces, self.stretches = texts.Cache(CACHE), texts.Cache(CACHE)

    def merge(self, ids: list[int]) -> list[int]:
        """Apply merges to a list of symbols, best rank first, leftmost first."""
        n, known = len(ids), self.merges.get
        if n < 2:
            return ids
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []
        for i in range(n - 1):
            m = known(ids[i] << 20 | ids[i + 1])
            if m is not None:
                heap.append((m >> 20) << 32 | i)
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            entry = pop(heap)
            i = entry & 0xFFFFFFFF
            j = right[i]
            if ids[i] < 0 or j < 0:
                continue                                    # merged away, or last by now
            m = known(ids[i] << 20 | ids[j])
            if m is None or m >> 20 != entry >> 32:
                continue                                    # the pair has changed since
            ids[i], ids[j] = m & 0xFFFFF, -1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                m = known(ids[i] << 20 | ids[k])
                if m is not None:
                    push(heap, (m >> 20) << 32 | i)
            h = left[i]
            if h >= 0:
                m = known(ids[h] << 20 | ids[i])
                if m is not None:
                    push(heap, (m >> 20) << 32 | h)
        same = self.same
        return [same[x] for x in ids if x >= 0]

    def piece(self, piece: str) -> list[int]:
        found = self.pieces.young.get(piece) or self.pieces.get(piece)
        if found is None:
            byte_id = self.byte_id
            found = self.merge([byte_id[b] for b in piece.encode("utf-8", "surrogatepass")])
            if len(piece) <= 64:
                self.pieces.put(piece, found)
        return found

    def stretch(self, text: str) -> list[int]:
        """Ids of a text between separating blanks, its leading blank included."""
        out: list[int] = []
        for p in self.cut(text):
            out += self.piece(p)
        if len(text) <= 64:
            self.stretches.put(text, out)
        return out

    def plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens.

        Where a single blank stands between two characters that are not white space the
        pattern always cuts before it, so the stretches between such blanks are encoded
        apart, and frequent ones come from the cache.
        """
        if not text:
            return []
        out: list[int] = []
        if _ODD.search(text) or text[0] == " " or text[-1] == " ":
            found = self.cut(text) if len(text) <= texts.CHUNK_BYTES else (m.group() for m in self.cut_each(text))
            for p in found:
                out += self.piece(p)
            return out
        known, older, make = self.stretches.young.get, self.stretches.get, self.stretch
        for piece in texts.pieces(text):
            head, *rest = piece.split(" ")
            if head:
                out += known(head) or older(head) or make(head)
            for w in rest:
                w = " " + w
                out += known(w) or older(w) or make(w)
        return out

    def encode(self, text: str) -> list[int]:
        if self.find_special is None or not self.find_special.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.find_special.finditer(text):
            out += self.plain(text[at:m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + self.plain(text[at:])

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """One coder for each worker process and vocabulary file."""
    return Coder(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of every row; map-only."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType),
                           T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in texts.small(batches, 1):
            ids = pa.array([c.encode(t) for t in texts.strings(batch.column(1))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``text`` of every row of ids; null ids give the empty text."""
    schema = T.StructType([T.StructField(id_col, tokens.schema[id_col].dataType),
                           T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            items = [c.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.string())], names=[id_col, "text"])

    return tokens.select(id_col, F.col("ids").cast("array<int>")).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: number of ids, SHA-256 of the ids (decimal, comma-joined) and of the
    text decoded from them. Ids and texts are digested in the task that makes them."""
    from hashlib import sha256

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                           T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        decimal = {i: str(i) for i in c.strings}.__getitem__
        for batch in texts.small(batches, 1):
            n, by_ids, by_text = [], [], []
            for text in texts.strings(batch.column(1)):
                ids = c.encode(text)
                n.append(len(ids))
                by_ids.append(sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                by_text.append(sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(by_ids, pa.string()), pa.array(by_text, pa.string())],
                names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
