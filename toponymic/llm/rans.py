"""Token-id files coded by a static range asymmetric numeral system.

A folder holds two Parquet tables. ``table``: the shared frequency of every vocabulary
id, scaled to ``2 ** BITS`` from the counts of all ids of the corpus (no id below 1, so
any text of the vocabulary can be coded). ``blocks``: one row for each block, in rising
order of ``doc_id`` from file to file and row to row. A block codes whole documents, about
``BLOCK`` ids or one longer document, and depends on nothing but the table:

    doc_ids, lengths   the documents and their numbers of ids
    start              number of ids before the block
    lanes, n           number of interleaved coder states; number of ids
    states             the states (64 bits each) at every checkpoint, every ``steps`` steps
    offsets            where each checkpoint's words begin in ``words``
    words              the 32-bit words of all lanes, in the order in which they are read
    crc                CRC-32 of the ids (32 bits each, little-endian), one a checkpoint

Id ``i`` belongs to lane ``i % lanes``. A reader can start at any checkpoint of any block
and checks what it decodes. All arrays are little-endian. Python's part is the coder:
numpy steps over all lanes at once; Spark partitions, sorts and stores.

Defined cases: a null text is empty and holds the end id only; rows with null ids come
first; rows that share an id are ordered by their ids' bytes; an empty table gives an
empty folder that reads back empty; a damaged block raises ValueError.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from toponymic.llm import ranges, storage, texts
from toponymic.llm.bpe import byte_symbols

BITS = 20
BLOCK = 1 << 20
LANES = 2048
STEPS = 256
#: Entries kept of each of the two caches of a worker. Results don't depend on it.
CACHE = 800_000
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


# ---------------------------------------------------------------- the coder

class Table:
    """Shared frequencies of ids ``0 .. len - 1``, which add up to ``2 ** BITS``."""

    def __init__(self, frequencies: np.ndarray):
        self.freq = frequencies.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.most = int(self.freq.argmax())

    @functools.cached_property
    def symbol(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.freq), dtype=np.int32), self.freq.astype(np.int64))


def scaled(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Counts scaled to a total of ``2 ** bits``, each at least 1. The rounding error is
    taken from, or given to, the largest ones."""
    total, goal = int(counts.sum()), 1 << bits
    if len(counts) > goal:
        raise ValueError(f"{len(counts)} ids don't fit in {bits} bits")
    freq = np.maximum(1, (counts.astype(float) * (goal / max(total, 1))).astype(np.int64))
    order = np.argsort(-freq, kind="stable")
    excess = int(freq.sum()) - goal
    while excess:
        for i in order:
            step = min(excess, max(0, int(freq[i]) - 1), max(1, int(freq[i]) // 16)) if excess > 0 else excess
            freq[i] -= step
            excess -= step
            if not excess:
                break
    return freq


def lanes_of(n: int) -> int:
    """As many lanes as keep at least 64 steps, up to ``LANES``."""
    return min(LANES, 1 << max(0, (n // 64).bit_length() - 1)) if n >= 64 else 1


def encode(ids: np.ndarray, table: Table) -> dict:
    """Codes the ids of a block (the last step is filled up with the most frequent id)."""
    n, lanes = len(ids), lanes_of(len(ids))
    steps = -(-n // lanes)
    padded = np.full(steps * lanes, table.most, dtype=np.int64)
    padded[:n] = ids
    padded = padded.reshape(steps, lanes)
    freq, cum = table.freq, table.cum
    shift, bits = np.uint64(63 - BITS), np.uint64(BITS)
    state = np.full(lanes, _LOW, dtype=np.uint64)
    words, written, marks = [], 0, []
    for s in range(steps - 1, -1, -1):
        f = freq[padded[s]]
        full = state >= f << shift
        if full.any():
            out = state[full]
            words.append(out.astype(np.uint32))
            written += len(out)
            state[full] = out >> _WORD
        q = state // f
        state = (q << bits) + (state - q * f) + cum[padded[s]]
        if s % STEPS == 0:
            marks.append((state.copy(), written))
    marks.reverse()
    raw = ids.astype("<u4")
    return {"n": n, "lanes": lanes, "states": b"".join(x.astype("<u8").tobytes() for x, _ in marks),
            "offsets": [written - w for _, w in marks],
            "words": np.concatenate(words[::-1]).astype("<u4").tobytes() if words else b"",
            "crc": [zlib.crc32(raw[i:i + STEPS * lanes].tobytes()) for i in range(0, n, STEPS * lanes)]}


def decode_from(block: dict, table: Table, mark: int) -> np.ndarray:
    """Ids between one checkpoint and the next, checked against their CRC."""
    lanes, n = block["lanes"], block["n"]
    first = mark * STEPS * lanes
    steps = min(STEPS, -(-(n - first) // lanes))
    state = np.frombuffer(block["states"], dtype="<u8", count=lanes, offset=8 * lanes * mark).astype(np.uint64)
    words = np.frombuffer(block["words"], dtype="<u4")
    at = block["offsets"][mark]
    freq, cum, symbol = table.freq, table.cum, table.symbol
    bits, low = np.uint64(BITS), np.uint64((1 << BITS) - 1)
    out = np.empty((steps, lanes), dtype=np.int32)
    try:
        for s in range(steps):
            slot = state & low
            out[s] = ids = symbol[slot]
            state = freq[ids] * (state >> bits) + slot - cum[ids]
            empty = np.flatnonzero(state < _LOW)
            if len(empty):
                state[empty] = state[empty] << _WORD | words[at:at + len(empty)]
                at += len(empty)
    except (IndexError, ValueError) as e:
        raise ValueError(f"damaged block at checkpoint {mark}") from e
    ids = out.reshape(-1)[:n - first].astype("<u4")
    if zlib.crc32(ids.tobytes()) != block["crc"][mark]:
        raise ValueError(f"damaged block at checkpoint {mark}")
    return ids


def decode(block: dict, table: Table) -> np.ndarray:
    parts = [decode_from(block, table, i) for i in range(len(block["offsets"]))]
    return np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")


# ---------------------------------------------------------------- ids of texts

class WordIds:
    """Ids of a vocabulary that drops white space, by the tokenizers library.

    No token spans a blank or a line feed, so the stretches between them are encoded
    apart and kept in a bounded cache. A stretch of Latin letters, with or without final
    commas and stops, goes to the library's merge model directly (its normaliser and
    pre-tokeniser would only lower it and cut off the marks); any other goes through the
    whole tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.stretches, self.cores = texts.Cache(CACHE), texts.Cache(CACHE)
        self.shown = {b: s for b, s in byte_symbols().items()}

    def _model(self, piece: str) -> bytes:
        """Ids of letters, or of marks, in lower case; kept, as a word comes with various marks."""
        found = self.cores.young.get(piece) or self.cores.get(piece)
        if found is None:
            if not piece.isascii():
                shown = piece.encode().decode("latin-1").translate(self.shown)
            else:
                shown = piece
            found = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            self.cores.put(piece, found)
        return found

    def _stretch(self, w: str) -> bytes:
        core = w.rstrip(",.")
        if core.isalpha() and (core.isascii() or max(core) <= "\xff"):
            found = self._model(core.lower())
            if len(core) < len(w):
                found += self._model(w[len(core):])
        else:
            found = array("I", self.tokenizer.encode(w, add_special_tokens=False).ids).tobytes()
        if len(w) <= 64:
            self.stretches.put(w, found)
        return found

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        known, older, make = self.stretches.young.get, self.stretches.get, self._stretch
        return b"".join([b"".join([known(w) or older(w) or make(w) for w in piece.split(" ") if w])
                         for piece in texts.pieces(text.replace("\n", " "))])


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def _packed(raw: bytes, tool: zstandard.ZstdCompressor) -> bytes:
    """Ids by byte position, compressed: small enough to shuffle."""
    return tool.compress(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(packed: bytes, tool: zstandard.ZstdDecompressor) -> np.ndarray:
    planes = np.frombuffer(tool.decompress(packed), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def tokenized(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n``, ``ids`` (packed, end id included) of every row; map-only. Each task adds
    a last row with ``counts`` alone: how often each id of the vocabulary came, packed. So counting costs no second
    pass over the ids, and a task that is run again counts its rows once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, tool, end = word_ids(path), zstandard.ZstdCompressor(level=1), end_id.to_bytes(4, "little")
        counts = np.zeros(max(coder.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1), dtype=np.int64)
        for batch in texts.small(batches, 1):
            raw = [coder.ids(t) + end for t in texts.strings(batch.column(1))]
            for lo, hi in texts.chunks([len(r) for r in raw], 4 * texts.CHUNK_BYTES):
                counts += np.bincount(np.frombuffer(b"".join(raw[lo:hi]), dtype="<u4"), minlength=len(counts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(r) // 4 for r in raw], pa.int64()),
                 pa.array([_packed(r, tool) for r in raw], pa.binary()), pa.nulls(len(raw), pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
             pa.array([tool.compress(counts.astype("<i8").tobytes())], pa.binary())], names=names)

    names = ["doc_id", "n", "ids", "counts"]
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, n long, ids binary, counts binary")


# ---------------------------------------------------------------- the files

def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n) of the packed counts of some tasks."""
    tool, n = zstandard.ZstdDecompressor(), np.zeros(0, dtype=np.int64)
    for batch in batches:
        for packed in batch.column(0).to_pylist():
            found = np.frombuffer(tool.decompress(packed), dtype="<i8")
            n = n + found if len(n) else found
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["id", "n"])


_BLOCKS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())),
    T.StructField("n", T.LongType()), T.StructField("lanes", T.IntegerType()), T.StructField("states", T.BinaryType()),
    T.StructField("offsets", T.ArrayType(T.LongType())), T.StructField("words", T.BinaryType()),
    T.StructField("crc", T.ArrayType(T.LongType()))])
_ARROW = {"part": pa.int32(), "block": pa.int64(), "start": pa.int64(), "doc_ids": pa.list_(pa.int64()),
          "lengths": pa.list_(pa.int64()), "n": pa.int64(), "lanes": pa.int32(), "states": pa.binary(),
          "offsets": pa.list_(pa.int64()), "words": pa.binary(), "crc": pa.list_(pa.int64())}


def _blocks(frequencies: np.ndarray, starts: dict[int, int], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, tool = Table(frequencies), zstandard.ZstdDecompressor()
        part, block, at, held = None, 0, 0, 0          # held: ids gathered for the block
        doc_ids: list = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            lengths = [len(x) for x in ids]
            row = {"part": part, "block": block, "start": at, "doc_ids": list(doc_ids), "lengths": lengths,
                   **encode(np.concatenate(ids), table)}
            return pa.RecordBatch.from_arrays([pa.array([row[k]], kind) for k, kind in _ARROW.items()], names=list(_ARROW))

        for batch in texts.small(batches, 2):
            for p, doc, packed in zip(*(c.to_pylist() for c in batch.columns)):
                new = _unpacked(packed, tool)
                if ids and (p != part or held + len(new) > size):
                    yield flush()
                    block, at, held = block + 1, at + held, 0
                    doc_ids, ids = [], []
                if p != part:
                    part, block, at = p, 0, starts[p]
                doc_ids.append(doc)
                ids.append(new)
                held += len(new)
        if ids:
            yield flush()

    return run


def write(tokens: DataFrame, folder: str, size: int, block: int = BLOCK) -> None:
    """Writes the files of a table of packed ids and counts (``tokenized``, read several times, so
    best a written one). ``size``: number of ids of the vocabulary, which bounds the counts that
    reach the driver; beside them it gets one row a range."""
    spark = tokens.sparkSession
    counts = np.zeros(size, dtype=np.int64)
    counted = tokens.where(F.col("counts").isNotNull()).select("counts")
    tokens = tokens.where(F.col("counts").isNull()).select("doc_id", "n", "ids")
    for r in counted.mapInArrow(_summed, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    frequencies = scaled(counts)
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(frequencies)], "id int, freq int").coalesce(1) \
        .write.parquet(f"{folder}/table")
    cuts = ranges.bounds(tokens, "doc_id", ranges.ranges(tokens))
    placed = tokens.withColumn(ranges.PART, ranges.range_of(F.col("doc_id"), cuts))
    sums = {r[ranges.PART]: r["n"] for r in placed.groupBy(ranges.PART).agg(F.sum("n").alias("n")).collect()}
    starts, total = {}, 0
    for p in sorted(sums):
        starts[p], total = total, total + sums[p]
    (placed.select(ranges.PART, "doc_id", "ids").repartitionById(len(cuts) + 1, F.col(ranges.PART))
     .sortWithinPartitions(ranges.PART, F.asc_nulls_first("doc_id"), "ids")
     .mapInArrow(_blocks(frequencies, starts, block), _BLOCKS)
     .write.option("compression", "uncompressed").parquet(f"{folder}/blocks"))


def _read_table(spark: SparkSession, folder: str) -> np.ndarray:
    rows = spark.read.schema("id int, freq int").parquet(f"{folder}/table").orderBy("id").collect()
    return np.array([r["freq"] for r in rows], dtype=np.int64)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``start``, ``ids`` (array) of every document of a folder."""
    frequencies = _read_table(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(frequencies)
        for doc_ids, starts, parts in _documents(batches, table):
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()),
                 pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks").mapInArrow(run, "doc_id long, start long, ids array<int>")


def _documents(batches: Iterator[pa.RecordBatch], table: Table) -> Iterator[tuple[list, list, list]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            ids = decode(row, table)
            ends = np.cumsum(row["lengths"])
            if int(ends[-1]) != len(ids):
                raise ValueError("damaged block: its documents don't add up")
            begins = ends - np.array(row["lengths"])
            yield row["doc_ids"], (begins + row["start"]).tolist(), [ids[a:b] for a, b in zip(begins, ends)]


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of a folder: ``start``, ``n_tokens`` and the CRC-32 of its decoded ids."""
    frequencies = _read_table(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(frequencies)
        for doc_ids, starts, parts in _documents(batches, table):
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array([len(p) for p in parts], pa.int64()),
                 pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end_id: int, folder: str | None = None) -> str:
    """Encodes the texts, writes the files and returns their folder."""
    folder = folder or storage.shared_folder(docs.sparkSession, "tokens")
    size = Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
    write(storage.written(tokenized(docs, path, end_id), "ids"), folder, size)
    return folder
