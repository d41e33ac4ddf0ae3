"""Quality by weak supervision: rules vote or abstain, a label model weighs them.

Each rule looks at a few counts of a text and votes good (1), bad (-1) or abstains (0).
How often a rule gives each vote on good and on bad documents is estimated without labels
by expectation-maximisation over all documents: the corpus is reduced to the number of
documents with each vote pattern (at most 3 ** rules rows, whatever the corpus size), and
the iterations run on that table. A document is kept when the posterior probability of
good quality, given its pattern, reaches ``KEEP``.

Defined cases: a null text has no words; a text without words gets only abstentions from
the share rules; equal texts get equal verdicts; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toponymic.llm import frames, storage, texts

WINDOW = 5
KEEP = 0.5
ITERATIONS = 100

_FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words",
             "n_plain_words", "n_upper", "n_letters", "n_marks", "n_doubled_words",
             "n_distinct_words"]


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_UPPER = _lut(bytes(range(65, 91)))
_ASCII_LETTER = _UPPER | _lut(bytes(range(97, 123)))
_LETTER = _ASCII_LETTER | _lut(bytes(range(128, 256)))      # any byte of a longer character counts
_SYMBOL = _lut(b"#*$%&|<>")
_MARK = _lut(b"!")
_PLAIN = _LETTER | _lut(b",.;:?'\"()-")                     # of words with nothing else in them
_START = np.ones(256, dtype=bool)
_START[128:192] = False                                     # not the first byte of a character
_WORD_CHAR = _START & ~texts.SPACE


def _running(mask: np.ndarray) -> np.ndarray:
    out = np.empty(len(mask) + 1, dtype=np.int64)
    out[0] = 0
    np.cumsum(mask, out=out[1:])
    return out


def _line_counts(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\v\f\r")]
    return len(lines), len(lines) - len(set(lines))


def counts(items: list[bytes], window: int = WINDOW) -> np.ndarray:
    """A row of counts (see ``_FEATURES``) for each text."""
    out = np.zeros((len(items), len(_FEATURES)), dtype=np.int64)
    for lo, hi in texts.chunks([len(t) for t in items]):
        part = items[lo:hi]
        w = texts.Words(part)
        n = w.counts()
        by_text = lambda table: w.sums(table[w.data])           # noqa: E731
        per_word = lambda mask: (lambda c: c[w.first[1:]] - c[w.first[:-1]])(_running(mask))
        inside = lambda table: w.inside(table[w.data])          # noqa: E731
        letters, size = inside(_LETTER), w.ends - w.starts
        hashes = w.hashes()
        owner = np.repeat(np.arange(hi - lo), n)
        doubled = np.zeros(len(hashes), dtype=bool)
        doubled[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        _, first_seen = np.unique(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)
        distinct = np.bincount(owner[first_seen], minlength=hi - lo)
        lines = np.array([_line_counts(t) for t in part], dtype=np.int64).reshape(-1, 2)
        columns = [n, by_text(_WORD_CHAR), by_text(_SYMBOL), lines[:, 1], per_word(_repeated(w, hashes, owner, window)),
                   lines[:, 0], per_word(letters > 0), per_word((inside(_PLAIN) == size) & (letters > 0)),
                   by_text(_UPPER), by_text(_ASCII_LETTER), by_text(_MARK), per_word(doubled), distinct]
        out[lo:hi] = np.stack(columns, axis=1)
    return out


def _repeated(w: texts.Words, hashes: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """Words inside a window of ``window`` words that their text holds twice or more."""
    n = len(hashes) - window + 1
    out = np.zeros(len(hashes), dtype=bool)
    if n < 2:
        return out
    whole = np.flatnonzero(owner[:n] == owner[window - 1:])
    key = owner[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)    # windows of one text only
    for j in range(window):
        key = key * np.uint64(0xD6E8FEB86659FD93) + hashes[whole + j]
    key = texts.mix(key)
    order = np.argsort(key)
    rising = key[order]
    same = np.zeros(len(rising) + 1, dtype=bool)
    same[1:-1] = rising[1:] == rising[:-1]
    twice = whole[order[same[1:] | same[:-1]]]
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + window, -1)
    return np.cumsum(edge[:-1]) > 0


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the counts of every whole text; map-only."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)]
                          + [T.StructField(c, T.LongType()) for c in _FEATURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.small(batches, 1):
            table = counts(texts.utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(table[:, j]) for j in range(len(_FEATURES)))],
                                             names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _share(part: Column, whole: Column) -> Column:
    """A share, null (so that its rule abstains) where there is nothing to share."""
    return part / F.when(whole > 0, whole)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules(prefix: str = "") -> dict[str, Column]:
    """The rules over the counts; each gives 1 (good), -1 (bad) or 0 (abstains)."""
    c = {name: F.col(prefix + name) for name in _FEATURES}
    per_word = lambda name: _share(c[name], c["n_words"])       # noqa: E731
    symbols, plain, letters, marks = map(per_word, ("n_symbols", "n_plain_words", "n_letter_words", "n_marks"))
    repeat, doubled, distinct = map(per_word, ("n_repeat_words", "n_doubled_words", "n_distinct_words"))
    length = per_word("word_chars")
    upper, dup = _share(c["n_upper"], c["n_letters"]), _share(c["n_dup_lines"], c["n_lines"])
    return {
        "symbols": _vote(symbols <= 0.1, symbols > 0.1),
        "plain": _vote(plain >= 0.6, plain < 0.6),
        "letters": _vote(letters >= 0.6, letters < 0.6),
        "upper": _vote(upper <= 0.3, upper > 0.3),
        "marks": _vote(marks <= 0.5, marks > 0.5),
        "repeat": _vote(repeat <= 0.2, repeat > 0.2),
        "lines": _vote(F.lit(False), (c["n_lines"] >= 4) & (dup > 0.4)),
        "distinct": _vote(F.lit(False), (c["n_words"] <= 64) & (distinct < 0.6)),
        "doubled": _vote(doubled <= 0.25, doubled > 0.25),
        "word_length": _vote((length >= 2) & (length <= 10), (length < 2) | (length > 10)),
        "words": _vote(c["n_words"] >= 50, c["n_words"] < 5),
    }


def fit(patterns: np.ndarray, weights: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Posterior probability of good quality for each vote pattern (rows of -1, 0, 1).

    Starts from rules that give a bad vote thirty times as often on bad documents as on
    good ones, then alternates posteriors and vote rates (with one pseudo-vote each).
    """
    m = patterns.shape[1]
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)    # pattern, rule, vote
    good = np.tile(np.array([0.01, 0.2, 0.79]), (m, 1))
    bad = np.tile(np.array([0.3, 0.3, 0.4]), (m, 1))
    prior = 0.8
    posterior = np.full(len(patterns), prior)
    for _ in range(iterations):
        a = np.log(prior) + np.einsum("prv,rv->p", onehot, np.log(good))
        b = np.log1p(-prior) + np.einsum("prv,rv->p", onehot, np.log(bad))
        new = 1 / (1 + np.exp(np.clip(b - a, -700, 700)))
        done, posterior = np.abs(new - posterior).max(initial=0) < 1e-9, new
        if done or not len(patterns):
            break
        for rates, p in ((good, posterior), (bad, 1 - posterior)):
            n = np.einsum("p,prv->rv", weights * p, onehot) + 1
            rates[:] = n / n.sum(axis=1, keepdims=True)
        prior = float(np.clip((weights * posterior).sum() / weights.sum(), 0.01, 0.99))
    return posterior


def _code(prefix: str = "") -> Column:
    """All votes of a row as one number."""
    return sum(((v + 1) * 3 ** i for i, v in enumerate(rules(prefix).values())), F.lit(0))


def train(counted: DataFrame) -> DataFrame:
    """``__votes``, ``quality``: the posterior of every vote pattern of a table of counts, at
    most 3 ** 11 rows."""
    seen = counted.groupBy(_code().alias("__votes")).count().orderBy("__votes").collect()   # a row for each pattern
    codes = np.array([r["__votes"] for r in seen], dtype=np.int64)
    patterns = np.stack([codes // 3 ** i % 3 - 1 for i in range(len(rules()))], axis=1)
    posterior = fit(patterns, np.array([r["count"] for r in seen], dtype=float))
    return counted.sparkSession.createDataFrame(
        [(int(c), float(p)) for c, p in zip(codes, posterior)], "__votes int, quality double")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """``id_col``, the counts, ``quality`` and ``good`` of every row; texts are read once."""
    counted = storage.written(features(docs, id_col, text_col), "quality")
    return (counted.withColumn("__votes", _code()).join(F.broadcast(train(counted)), "__votes", "left").drop("__votes")
            .withColumn("good", F.coalesce(F.col("quality") >= keep, F.lit(False))))


def good_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that neither the fixed rule nor the label model rejects, with
    their columns. Texts are counted twice, so that no text is shuffled."""
    model = train(storage.written(features(docs, id_col, text_col), "quality"))
    prefix = frames.fresh(docs, "__q")
    fields = [T.StructField(prefix + c, T.LongType()) for c in _FEATURES]

    def make(column: pa.Array) -> list[pa.Array]:
        table = counts(texts.utf8(column))
        return [pa.array(table[:, j]) for j in range(len(_FEATURES))]

    votes, score = frames.fresh(docs, "__votes"), frames.fresh(docs, "__quality")
    model = model.withColumnsRenamed({"__votes": votes, "quality": score})
    judged = frames.with_columns(docs, text_col, fields, make).withColumn(votes, _code(prefix))
    return (judged.join(F.broadcast(model), votes, "left").where(~base_failed(prefix) & (F.col(score) >= keep))
            .select(*docs.columns))


def base_failed(prefix: str = "") -> Column:
    """The fixed rule beside the model: too few words, or too many of them repeated."""
    words, repeated = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (words < 10) | (100 * repeated > 20 * words)
