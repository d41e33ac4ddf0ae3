"""Secrets in text: fixed patterns, and character Markov models for the rest.

Three patterns label strings for certain: values assigned to a secret's name, access
keys, and long runs of hexadecimal digits. They are also the labelled samples of random
strings: a first-order Markov model of characters is trained on the matches of each
pattern, beside one of uniformly random letters and digits; everything else in the
corpus trains the model of ordinary identifiers. All are counted over all documents (a
table of 69 x 69 counts for each model leaves the executors). Every run of ``MIN_RUN`` or
more identifier characters, less the pattern spans in it, is split at separators.
Neighbouring tokens for which one random model (all weigh the same) has a higher likelihood
than ordinary text, as a whole or in a part that alone is enough, are a secret from a
log-likelihood ratio of ``MIN_LLR`` and ``MIN_RUN`` characters on.

Defined cases: a null text is empty and has no spans; offsets are code points with an
exclusive end; equal rows give equal results; an empty table gives an empty table and a
model that knows only its priors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toponymic.llm import texts

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "random")
MIN_RUN = 8
MIN_LLR = 12.0
#: Weight, in transitions for each preceding character, of the frequencies of single characters,
#: on which a model falls back where it has seen few transitions.
PRIOR = 20.0

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")     # maximal runs, so the same as dropping short ones
_SEPARATORS = b"+/_=-"

_ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_K = len(_ALPHABET) + 1
_CODE = np.zeros(256, dtype=np.int64)   # 0: any other byte, that is, a boundary
_CODE[list(_ALPHABET)] = np.arange(1, _K)
_HEX_MARK = bytes(104 if c in b"0123456789abcdef" else 32 for c in range(256))
_IN_RUN = np.zeros(256, dtype=bool)
_IN_RUN[[c for c in _ALPHABET if c != ord(".")]] = True
_RUN_MARK = bytes(120 if c else 32 for c in _IN_RUN)
_SPLITS = np.zeros(256, dtype=bool)
_SPLITS[list(_SEPARATORS)] = True


def base_spans(text: str, raw: bytes | None = None) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, start of the value) of the pattern matches, by start."""
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    found = []
    if b"=" in raw or b":" in raw:
        found += [(m.start(), 0, m.end(), m.start(1)) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"h" * 24 in raw.translate(_HEX_MARK):
        found += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(found)


def _transitions(data: bytes) -> np.ndarray:
    out = np.zeros(_K * _K, dtype=np.int64)
    for at in range(0, len(data) - 1, texts.CHUNK_BYTES):
        code = _CODE[np.frombuffer(data[at:at + texts.CHUNK_BYTES + 1], dtype=np.uint8)]
        out += np.bincount(code[:-1] * _K + code[1:], minlength=_K * _K)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = np.zeros((len(KINDS), _K * _K), dtype=np.int64)        # the patterns' kinds, then ordinary text
    for batch in texts.small(batches, 0):
        for text, raw in zip(texts.strings(batch.column(0)), texts.utf8(batch.column(0))):
            spans = base_spans(text, raw)
            if spans:
                for start, kind, end, value in spans:
                    tables[kind] += _transitions(text[value:end].encode())
                    text = text[:start] + " " * (end - start) + text[end:]
                raw = text.encode("utf-8", "surrogatepass")
            tables[-1] += _transitions(raw)
    for model, counts in enumerate(tables):
        at = np.flatnonzero(counts)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([model] * len(at), pa.int32()), pa.array(at), pa.array(counts[at])],
                                             names=["model", "step", "n"])


def train(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log-likelihood ratio of every transition for each random model, counted over all
    rows of ``docs``. A separator may speak against a random string, but not for one."""
    counts = (docs.select(text_col).mapInArrow(_count, "model int, step long, n long")
              .groupBy("model", "step").agg(F.sum("n").alias("n")))
    tables = np.zeros((len(KINDS), _K, _K))
    for r in counts.collect():      # at most 4 * 69 * 69 rows
        tables[r["model"]].flat[r["step"]] = r["n"]
    tables = tables[:, 1:, 1:]
    single = tables.sum(axis=1, keepdims=True) + 1                  # how often each character follows any other
    tables = tables + PRIOR * single / single.sum(axis=2, keepdims=True)
    logs = np.log(tables / tables.sum(axis=2, keepdims=True))
    uniform = np.full((1, _K - 1, _K - 1), -np.log(62))
    ratios = np.concatenate([logs[:-1], uniform]) - logs[-1]
    split = _SPLITS[list(_ALPHABET)]
    return np.where(split[:, None] | split, np.minimum(ratios, 0), ratios)


def llr(run: str, ratios: np.ndarray) -> float:
    """Log-likelihood ratio of an identifier, random against ordinary."""
    code = _CODE[np.frombuffer(run.encode("ascii"), dtype=np.uint8)] - 1
    return float(ratios[:, code[:-1], code[1:]].sum(axis=1).max() - np.log(len(ratios)))


def _without(text: str, base: list[tuple[int, int, int, int]]) -> str:
    """The text with blanks in place of the base spans."""
    out, at = [], 0
    for start, _, end, _ in base:
        if end > at:
            out += [text[at:start], " " * (end - max(at, start))]
            at = end
    return "".join([*out, text[at:]])


def _gains(sums: np.ndarray, least: float) -> np.ndarray:
    """For each model the ratio of a token, or of its best part of ``MIN_RUN`` characters or
    more if that alone is enough. ``sums``: running sums at its characters."""
    whole = sums[:, -1] - sums[:, 0]
    if sums.shape[1] < MIN_RUN:
        return whole
    best = (sums[:, MIN_RUN - 1:] - np.minimum.accumulate(sums, axis=1)[:, :sums.shape[1] - MIN_RUN + 1]).max(axis=1)
    return np.where(best >= least, best, whole)


def _random_parts(run: np.ndarray, ratios: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of the random parts of a run (bytes): neighbouring tokens between separators
    that one random model explains better, from ``MIN_RUN`` characters on."""
    least = MIN_LLR + np.log(len(ratios))
    code = _CODE[run] - 1
    sums = np.zeros((len(ratios), len(run)))
    np.cumsum(ratios[:, code[:-1], code[1:]], axis=1, out=sums[:, 1:])
    cuts = [-1, *np.flatnonzero(_SPLITS[run]).tolist(), len(run)]
    tokens = [(a + 1, b, _gains(sums[:, a + 1:b], least)) for a, b in zip(cuts, cuts[1:]) if b > a + 1]
    found = []
    for model in range(len(ratios)):
        total = start = end = 0
        for a, b, gains in [*tokens, (0, 0, None)]:
            gain = -1 if gains is None else gains[model]
            if gain > 0:
                start, end, total = (start if total else a), b, total + gain
            elif gain < 0:                                            # a single letter (0) parts nothing
                if total >= least and end - start >= MIN_RUN:
                    found.append((start, end))
                total = 0
    merged: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if merged and start < merged[-1][1]:
            merged[-1] = merged[-1][0], max(end, merged[-1][1])
        else:
            merged.append((start, end))
    return merged


def _random_spans(raw: bytes, ratios: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end, in code points, of the random parts of all runs of a text."""
    best = np.maximum(ratios.max(axis=0), 0)                          # no part of a run gains more than this
    least = MIN_LLR + np.log(len(ratios))
    at = points = 0
    while at < len(raw):
        stop = at + texts.CHUNK_BYTES
        while stop < len(raw) and _IN_RUN[raw[stop]]:                 # never inside a run
            stop += 1
        data = np.frombuffer(raw[at:stop], dtype=np.uint8)
        edges = np.flatnonzero(np.diff(_IN_RUN[data], prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= MIN_RUN
        starts, ends = starts[long], ends[long]
        position = None
        if len(starts):
            code = _CODE[data] - 1                                    # -1, any other byte, is met between runs only
            sums = np.concatenate([[0.0], np.cumsum(best[code[:-1], code[1:]])])
            for s, e in zip(starts, ends):
                if sums[e - 1] - sums[s] < least:
                    continue
                for a, b in _random_parts(data[s:e], ratios):
                    if position is None:
                        position = points + np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    yield int(position[s + a]), int(position[s + b])
        points += int(((data & 0xC0) != 0x80).sum())
        at = stop


def spans(text: str, ratios: np.ndarray, raw: bytes | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all secrets, pattern spans and parts of runs found random."""
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    base = base_spans(text, raw)
    found = [(s, k, e) for s, k, e, _ in base]
    if base:
        raw = _without(text, base).encode("utf-8", "surrogatepass")
    if b"x" * MIN_RUN in raw.translate(_RUN_MARK):
        found += [(s, 3, e) for s, e in _random_spans(raw, ratios)]
    return sorted(found)


def secret_spans(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans`` (array of kind, start, end, by start) of every row; map-only."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                         T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType),
                           T.StructField("spans", T.ArrayType(span))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.small(batches, 1):
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans(text, ratios, raw)]
                     for text, raw in zip(texts.strings(batch.column(1)), texts.utf8(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=[id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
