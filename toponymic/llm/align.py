"""Alignment of two tokenizers: which tokens of one cover the same bytes as tokens of the other.

A text is encoded by a byte-level BPE (A, over a blank and the text) and by a sentencepiece
model with byte fallback (B, over the text; it sets a blank in front itself). Character offsets of
A and the spans of B's proto give the coarse cuts: places between characters where a
token of both ends. A part between two cuts that is plain ASCII is cut further by those
same offsets; a part with multibyte characters or byte-fallback tokens is cut by the
lengths of the tokens' decoded bytes. Tokens between two neighbouring cuts are a group; all
its A-B pairs are linked.

Both encoders always cut before a blank between two characters that aren't white space (A's
pattern does, and no piece of B has its blank mark behind another character; that is
checked). So a text is taken as stretches, each with its leading blank, and frequent
stretches come from a cache; results don't depend on it. Links of a stretch are kept as
distinct pairs with their number, never as a list of all occurrences.

Corpus-wide, the number of documents that hold a pair linked is counted by Spark from
one row per task and pair. The most frequent pairs (``HEAD`` at most, whatever the corpus) and
the best count of each A id (at most the vocabulary) are sent to all tasks; documents'
rarer pairs are shuffled and joined with their counts. A rare pair is in few
documents, so no key of that join is hot, and no pair is left out.

Defined cases: a null or empty text, or one whose tokens' bytes aren't those of the blank and the
text (a literal U+2581, a lone surrogate), has no tokens: zeros and an empty digest. Strings of special tokens
are plain text. Texts of any length are taken in pieces of about 1 MB. Repeated rows are
documents of their own, with or without an id. Other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toponymic.llm import storage, texts
from toponymic.llm.bpe import byte_symbols

#: Pairs whose counts are sent to all tasks (16 bytes each).
HEAD = 1 << 20
#: Stretches that a worker keeps, and the longest of them in characters.
CACHE, LONGEST = 700_000, 64
#: A pair is A's id << SHIFT | B's id, so vocabularies have 2^SHIFT entries at most.
SHIFT = 20
#: Characters of new stretches that are encoded at once, and links of a group whose pairs are laid out one by one.
JOINED, FEW = 1 << 13, 64
#: Pairs counted in a task before equal ones are added up, and distinct ones kept before they are sent on.
GATHER, KEEP = 1 << 21, 1 << 22
_CUT = re.compile(r"(?<=\S) (?=\S)")


#: Stands for a stretch whose tokens' bytes aren't its own.
BAD = np.array([0xFFFFFFFF], np.uint32).tobytes()


class Aligner:
    """Both tokenizers of a worker, and the codes of frequent stretches.

    The code of a stretch has a number for each token: its id, its side (0 for A, 1 for B) and
    whether it is the last of its side in its group; group by group, A before B.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        back = {c: bytes([b]) for b, c in byte_symbols().items()}
        vocab = self.a.get_vocab()
        self.bytes_a: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            self.bytes_a[i] = b"".join(back[c] if c in back else c.encode() for c in s)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.is_byte = np.array([self.b.is_byte(i) for i in range(len(pieces))])
        self.bytes_b = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode()
                        for p, byte in zip(pieces, self.is_byte)]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece of the sentencepiece model goes over a blank: texts can't be taken by stretches")
        if max(len(self.bytes_a), len(pieces)) > 1 << SHIFT:
            raise ValueError(f"a vocabulary of over 2^{SHIFT} entries")
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.text = [f"{i}{end}" for i in range(max(len(self.bytes_a), len(pieces))) for end in (",", "|", ",", ";")]
        self.known = texts.Cache(CACHE)

    def codes(self, found: list[str]) -> list[bytes]:
        """The code of every stretch (each with its leading blank)."""
        young, old = self.known.young.get, self.known.get
        out = [young(s) or old(s) for s in found]
        missing = list(dict.fromkeys(s for s, x in zip(found, out) if x is None))
        if missing:
            fresh = {}
            # stretches that begin or end with white space, or hold B's own mark for a blank, are encoded alone
            plain = [s for s in missing if len(s) > 1 and not s[1].isspace() and not s[-1].isspace() and "\u2581" not in s]
            for lo, hi in texts.chunks([len(s) for s in plain], JOINED):
                fresh.update(zip(plain[lo:hi], self.align(plain[lo:hi])))
            for s in missing:
                x = fresh.get(s)
                if x is None:
                    x = fresh[s] = self.align([s])[0]
                if len(s) <= LONGEST:
                    self.known.put(s, x)
            out = [fresh[s] if x is None else x for s, x in zip(found, out)]
        return out

    def documents(self, items: list[str], most: int = texts.CHUNK_BYTES) -> list["Document"]:
        """Every text aligned; pieces of several texts are looked up together, up to about ``most`` characters."""
        out, waiting, size = [Document() for _ in items], [], 0
        collects = gc.isenabled()
        gc.disable()        # millions of short-lived tuples and no cycles: the collector would only walk the caches
        try:
            for doc, text in zip(out, items):
                for piece in cuts(text, most) if text else ():
                    waiting.append((doc, [" " + s for s in _CUT.split(piece)]))
                    size += len(piece)
                    if size >= most:
                        self.add(waiting)
                        waiting, size = [], 0
            self.add(waiting)
        finally:
            if collects:
                gc.enable()
        return out

    def add(self, pieces: list[tuple["Document", list[str]]]) -> None:
        """Aligns pieces and adds each to its text."""
        codes, at, left = self.codes([s for _, found in pieces for s in found]), 0, []
        for doc, found in pieces:
            code = np.frombuffer(b"".join(codes[at:at + len(found)]), np.uint32)
            at += len(found)
            doc.bad = doc.bad or code.max() == 0xFFFFFFFF
            if not doc.bad:
                left.append((doc, code))
        if not left:
            return
        size = [len(c) for _, c in left]
        all_ = np.concatenate([c for _, c in left])
        keys, times, n = linked(all_, np.repeat(np.arange(len(left)), size))
        stop = np.searchsorted(keys, np.arange(1, len(left) + 1, dtype=np.uint64) << np.uint64(2 * SHIFT)).tolist()
        text = self.text.__getitem__
        for i, ((doc, code), lo, hi) in enumerate(zip(left, [0, *stop], stop)):
            doc.add("".join(map(text, code.tolist())), n[i], keys[lo:hi] - np.uint64(i << 2 * SHIFT), times[lo:hi])

    def align(self, some: list[str]) -> list[bytes]:
        """Codes of several stretches that are encoded as one text."""
        text = "".join(some)
        whole = text.encode()
        enc = self.a.encode(text, add_special_tokens=False)
        a_ids, spans = enc.ids, enc.offsets
        pieces = self.b.encode(text[1:], return_type="proto").pieces
        found = [(p.id, p.end) for p in pieces]
        b_ids = [x for x, _ in found]
        if b"".join(map(self.bytes_a.__getitem__, a_ids)) != whole or b"".join(map(self.bytes_b.__getitem__, b_ids)) != whole:
            return [BAD] if len(some) == 1 else [self.align([s])[0] for s in some]
        flat_a, flat_b = np.array(a_ids, np.int64), np.array(b_ids, np.int64)

        # coarse: A's spans count characters; a token ends inside a character if the next one begins before its end
        span = np.array(spans, np.int64)
        end_a = span[:, 1]
        if len(whole) != len(text):
            place = np.flatnonzero(np.concatenate([(np.frombuffer(whole, np.uint8) & 0xC0) != 0x80, [True]]))
            inside = np.zeros(len(span), bool)
            inside[:-1] = span[1:, 0] < span[:-1, 1]
            end_a = np.where(inside, np.cumsum(self.len_a[flat_a]), place[end_a])       # refined by decoded bytes
        # B's spans count bytes, without the blank in front; a fallback byte that isn't a character's last has an empty one
        ends = np.array([x for _, x in found], np.int64)
        inside = self.is_byte[flat_b]
        if inside.any():
            inside &= ends == np.concatenate([[0], ends[:-1]])
        end_b = np.where(inside, np.cumsum(self.len_b[flat_b]), ends + 1)

        # groups lie between the ends that both have
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        all_a, all_b = np.bincount(group_a, minlength=len(both)), np.bincount(group_b, minlength=len(both))
        before_b, through_a = np.cumsum(all_b) - all_b, np.cumsum(all_a)
        code = np.empty(len(flat_a) + len(flat_b), np.uint32)
        code[np.arange(len(flat_a)) + before_b[group_a]] = flat_a << 2 | (both[group_a] == end_a)
        code[np.arange(len(flat_b)) + through_a[group_b]] = flat_b << 2 | 2 | (both[group_b] == end_b)
        packed = code.tobytes()
        stop = np.cumsum([len(s.encode()) for s in some])
        cuts = ((np.searchsorted(end_a, stop, "right") + np.searchsorted(end_b, stop, "right")) * 4).tolist()
        return [packed[lo:hi] for lo, hi in zip([0, *cuts], cuts)]


def linked(code: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of the codes of several texts and how often each is linked, in rising order
    of text and pair; and tokens of A, of B, groups and links of every text.

    ``owner``: the number of the text of each code. A group's pairs are laid out only where it
    has few; a large one is counted from its distinct ids, so it costs its distinct
    pairs and not its links. The result's keys have the text's number above the pair.
    """
    is_b, last = (code & 2) > 0, (code & 1) > 0
    at_a, at_b = np.flatnonzero(~is_b), np.flatnonzero(is_b)
    shift = np.uint64(SHIFT)
    ids = (code >> 2).astype(np.uint64)
    a, b = owner[at_a].astype(np.uint64) << shift | ids[at_a], ids[at_b]
    end_a, end_b = np.flatnonzero(last[at_a]) + 1, np.flatnonzero(last[at_b]) + 1
    n_a, n_b = end_a.copy(), end_b.copy()
    n_a[1:] -= end_a[:-1]
    n_b[1:] -= end_b[:-1]
    links = n_a * n_b
    few = links <= FEW
    # token by token of A: its pairs with all tokens of B in its group
    turn = np.repeat(np.where(few, n_b, 0), n_a)
    first = np.repeat(end_b - n_b, n_a) - (np.cumsum(turn) - turn)
    keys = np.repeat(a, turn) << shift | b[np.repeat(first, turn) + np.arange(turn.sum())]
    keys.sort()
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    keys, times = keys[new], np.diff(np.append(new, len(keys))).astype(np.uint64)
    for g in np.flatnonzero(~few).tolist():
        (x, nx), (y, ny) = (np.unique(i[end - n:end], return_counts=True) for i, end, n in
                            ((a, end_a[g], n_a[g]), (b, end_b[g], n_b[g])))
        keys = np.concatenate([keys, (x[:, None] << shift | y[None]).ravel()])
        times = np.concatenate([times, (nx[:, None] * ny[None]).ravel().astype(np.uint64)])
    if not few.all():
        keys, times = summed(keys, times)
    of = owner[at_b[end_b - 1]]
    texts_ = int(owner[-1]) + 1
    n = np.stack([np.bincount(owner[at_a], minlength=texts_), np.bincount(owner[at_b], minlength=texts_),
                  np.bincount(of, minlength=texts_), np.bincount(of, links, minlength=texts_).astype(np.int64)], axis=1)
    return keys, times, n


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in rising order with the sum of their numbers."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(times, first)


@functools.lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner for each worker process."""
    return Aligner(path_a, path_b)


def cuts(text: str, most: int = texts.CHUNK_BYTES) -> Iterator[str]:
    """A text in pieces of about ``most`` characters, cut at blanks that separate stretches; those blanks are left out."""
    at = 0
    while len(text) - at > most:
        found = _CUT.search(text, at + most)
        if found is None:
            break
        yield text[at:found.start()]
        at = found.end()
    yield text[at:] if at else text


class Document:
    """Counts, digest and pairs of one text, put together from its pieces."""

    def __init__(self):
        self.n = np.zeros(4, dtype=np.int64)
        self.digest, self.begun, self.bad = hashlib.sha256(), False, False
        self.keys, self.times = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def add(self, groups: str, n: np.ndarray, keys: np.ndarray, times: np.ndarray) -> None:
        self.digest.update(((";" if self.begun else "") + groups[:-1]).encode())
        self.begun = True
        self.n += n
        if len(self.keys):
            keys, times = summed(np.concatenate([self.keys, keys]), np.concatenate([self.times, times]))
        self.keys, self.times = keys, times

    def row(self) -> tuple:
        if self.bad or not self.begun:
            return 0, 0, 0, 0, "", b"", b""
        steps = self.keys.copy()                            # rising keys: small steps take little space
        steps[1:] -= self.keys[:-1]
        return (*self.n.tolist(), self.digest.hexdigest(), steps.tobytes(), self.times.tobytes())


COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_KEY, _STEPS, _TIMES = "__row", "__steps", "__times"


def documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, a key of the row, the counts, the digest of the groups and the packed pairs; map-only.

    The key is the number of the task and of the row in it, so it is only fixed once the rows are written.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(_KEY, T.LongType()),
                           *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("groups_sha256", T.StringType()),
                           T.StructField(_STEPS, T.BinaryType()), T.StructField(_TIMES, T.BinaryType())])
    kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(path_a, path_b)
        key = TaskContext.get().partitionId() << 36
        for batch in texts.small(batches, 1):
            rows = []
            for doc in tool.documents(texts.strings(batch.column(1))):
                rows.append((key, *doc.row()))
                key += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, kind) for x, kind in zip(zip(*rows), kinds))], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _pairs(steps: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(steps, np.uint64), dtype=np.uint64), np.frombuffer(times, np.uint64)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair`` (A id << SHIFT | B id), ``n``: documents that hold it linked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda k, n: pa.RecordBatch.from_arrays(      # noqa: E731
            [pa.array(k.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])
        waiting, held, total = [], 0, (np.zeros(0, np.uint64), np.zeros(0, np.uint64))

        def gathered():
            each = np.unique(np.concatenate(waiting), return_counts=True)
            return summed(*(np.concatenate(x) for x in zip(total, (each[0], each[1].astype(np.uint64)))))

        for batch in texts.small(batches, 0):
            for steps in batch.column(0).to_pylist():
                if steps:
                    waiting.append(np.cumsum(np.frombuffer(steps, np.uint64), dtype=np.uint64))
                    held += len(waiting[-1])
                if held > GATHER:
                    total = gathered()
                    waiting, held = [], 0
                    if len(total[0]) > KEEP:
                        yield out(*total)
                        total = (total[0][:0], total[1][:0])
        if waiting:
            total = gathered()
        if len(total[0]):
            yield out(*total)

    return aligned.select(_STEPS).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _arrays(df: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns of a bounded frame on the driver, by the first one's rising values."""
    found = df.select(*names).toArrow()
    columns = [found.column(n).to_numpy() for n in names]
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def head_threshold(counts: DataFrame, head: int) -> int:
    """The smallest power of two such that at most ``head`` pairs have that count or more."""
    levels = {r["level"]: r["n"] for r in counts.groupBy(F.floor(F.log2("n")).alias("level"))
              .agg(F.count("*").alias("n")).collect()}      # 64 rows at most
    total = 0
    for level in sorted(levels, reverse=True):
        total += levels[level]
        if total > head:
            return 1 << (level + 1)
    return 1


def scored(aligned: DataFrame, counts: DataFrame, head: int = HEAD) -> DataFrame:
    """``aligned`` without its pairs, with ``n_best`` and ``count_sum`` from the counts of the corpus.

    Both frames are written tables, as they are read more than once.
    """
    spark = aligned.sparkSession
    least = head_threshold(counts, head)
    best_id, best_n = _arrays(counts.groupBy(F.shiftright("pair", SHIFT).alias("a")).agg(F.max("n").alias("n")), "a", "n")
    common = _arrays(counts.where(F.col("n") >= least), "pair", "n")
    sent = spark.sparkContext.broadcast((best_id, best_n, *common))
    keep = [c for c in aligned.columns if c not in (_STEPS, _TIMES)]
    schema = T.StructType([*(aligned.schema[c] for c in keep), T.StructField("n_best", T.LongType()),
                           T.StructField("count_sum", T.LongType())])

    def look_up(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of the pairs (0 if not among the common ones), and the best of their A id."""
        best_id, best_n, pair, n = sent.value
        best = best_n[np.searchsorted(best_id, keys >> SHIFT)]
        at = np.minimum(np.searchsorted(pair, keys), max(len(pair) - 1, 0))
        count = np.where(pair[at] == keys, n[at], 0) if len(pair) else np.zeros_like(best)
        return count, best, count == 0

    def head_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.small(batches, len(keep)):
            best, total = [], []
            for steps, times in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist()):
                keys, times = _pairs(steps, times)
                count, top, _ = look_up(keys.astype(np.int64))
                times = times.astype(np.int64)
                best.append(int(times[count == top].sum()))
                total.append(int((times * count).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(best, pa.int64()), pa.array(total, pa.int64())],
                                             names=schema.names)

    def tail_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.small(batches, 1):
            for row, steps, times in zip(*(c.to_pylist() for c in batch.columns)):
                keys, times = _pairs(steps, times)
                keys = keys.astype(np.int64)
                _, top, rare = look_up(keys)
                if rare.any():
                    k = keys[rare]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(k), row)), pa.array(k), pa.array(times[rare].astype(np.int64)), pa.array(top[rare])],
                        names=[_KEY, "pair", "times", "top"])

    first = aligned.select(*keep, _STEPS, _TIMES).mapInArrow(head_part, schema)
    if least <= 1:
        return first.drop(_KEY)                             # every pair is a common one
    rare = aligned.select(_KEY, _STEPS, _TIMES).mapInArrow(tail_part, f"{_KEY} long, pair long, times long, top long")
    joined = rare.join(counts.where(F.col("n") < least), "pair")
    rest = joined.groupBy(_KEY).agg(F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("__best"),
                                    F.sum(F.col("times") * F.col("n")).alias("__sum"))
    both = first.join(rest, _KEY, "left")
    added = {"n_best": "__best", "count_sum": "__sum"}
    return both.select(*(c for c in keep if c != _KEY),
                       *((F.col(c) + F.coalesce(more, F.lit(0))).alias(c) for c, more in added.items()))


def aligned_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
                      head: int = HEAD) -> DataFrame:
    """Per row: the id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, ``n_best`` (links whose count
    is the highest of their A id in the corpus) and ``count_sum`` (of the counts over all links)."""
    found = storage.written(documents(docs, path_a, path_b, id_col, text_col), "aligned")
    return scored(found, storage.written(pair_counts(found), "pairs"), head)
