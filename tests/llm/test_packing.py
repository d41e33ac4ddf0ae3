import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from pyspark.sql import functions as F

from toponymic.llm import bpe, packing, queries, simhash

SCHEMA = "doc_id long, text string, lang string, source string, bin string, shard string"


def plain_best_fit(pieces, capacity):
    """The tightest compatible bin, by looking at every bin."""
    bins, out = [], []                        # residual, sources, clusters
    for length, source, cluster in pieces:
        fits = [(r, i) for i, (r, s, c) in enumerate(bins) if r >= length and (source is None or source not in s)
                and (cluster is None or cluster not in c)]
        if fits:
            tightest = min(fits)[0]
        else:
            tightest = capacity
            bins.append([capacity, set(), set()])
        out.append((length, tightest))
        options = [i for r, i in fits if r == tightest] or [len(bins) - 1]
        out[-1] += (options,)
        yield out[-1], bins


@pytest.mark.parametrize("seed", range(6))
def test_each_piece_goes_to_a_tightest_compatible_bin(seed):
    rng = random.Random(seed)
    capacity = 50
    pieces = [(rng.randint(1, capacity), rng.choice([None, 0, 0, 1, 2, 3]), rng.choice([None] * 5 + [0, 1])) for _ in range(400)]
    if seed % 2:
        pieces.sort(key=lambda p: -p[0])
    bins = []
    for (length, source, cluster), (b, offset) in zip(pieces, packing.best_fit(pieces, capacity)):
        fits = [r for r, s, c in bins if r >= length and (source is None or source not in s) and (cluster is None or cluster not in c)]
        if b == len(bins):
            assert not fits
            bins.append((capacity, frozenset(), frozenset()))
        r, s, c = bins[b]
        assert r >= length and offset == capacity - r
        assert not fits or r == min(fits)
        assert (source is None or source not in s) and (cluster is None or cluster not in c)
        bins[b] = (r - length, s | {source} - {None}, c | {cluster} - {None})


def check_bins(rows, items, capacity):
    """Every unit of every document is placed once, bins keep their bounds and conflicts."""
    bins, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        if r["bin"] is not None:
            bins[r["bin"]].append(r)
    for b, held in bins.items():
        at = 0
        for r in sorted(held, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["piece_length"]
        assert at <= capacity
    want = Counter()
    for d, n, *_ in items:
        want[d] += n
    assert {d: sum(r["piece_length"] for r in held) for d, held in docs.items()} == dict(want)
    return bins


def test_documents(spark):
    rng = random.Random(5)
    items = [(i, rng.choice([0, 1, 5, 30, 64, 65, 200, 640]), 7 if i % 3 == 0 else rng.randint(0, 4), rng.choice([None, 1, 2, 3]))
             for i in range(900)] + [(2000, 10_000, 7, None), (2001, 40, None, None)]
    df = spark.createDataFrame(items, "doc_id long, length long, source long, cluster long").repartition(4)
    rows = packing.pack_items(df, capacity=64, shard=100).collect()
    bins = check_bins(rows, items, 64)
    by_id = {d: (s, c) for d, _, s, c in items}
    for held in bins.values():
        for j in (0, 1):
            seen = [by_id[r["doc_id"]][j] for r in held if by_id[r["doc_id"]][j] is not None]
            assert len(seen) == len(set(seen))
    assert {r["doc_id"] for r in rows if r["bin"] is None} == {d for d, n, *_ in items if n == 0}
    for r in rows:
        assert r["piece_start"] == r["piece"] * 64
    assert len({r["bin"] >> 32 for r in rows if r["bin"] is not None}) == 10         # shards
    again = packing.pack_items(df.repartition(7), capacity=64, shard=100).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_repeats_nulls_and_empty(spark, tmp_path):
    data = [(1, "a b c", "en", "s", "x", "y")] * 3 + [(None, "d e", None, None, None, None)] * 2 + [
        (2, None, None, "s", None, None), (3, " \n", None, "s", None, None), (4, "A  b C", None, "t", None, None), (5, "w " * 5000, None, "s", "x", "y")]
    df = spark.createDataFrame(data, SCHEMA)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op9_packing(spark, str(tmp_path)).collect()
    check_bins(rows, [(d, len((t or "").split())) for d, t, *_ in data], packing.CAPACITY)
    placed = [r["bin"] for r in rows if r["doc_id"] in (1, 4)]
    assert len(set(placed)) == 4                              # one source, or copies up to case and spacing: apart
    assert packing.pack(df.limit(0), F.lit(1), F.col("source"), F.lit(None)).collect() == []


def test_near_copies_are_apart(spark, tmp_path):
    rng = random.Random(8)
    base = ["w%d" % rng.randrange(10 ** 6) for _ in range(400)]
    texts = [" ".join(base)]
    while len(texts) < 12:                                    # one word changed, within the bits of op 5
        other = list(base)
        other[rng.randrange(len(base))] = "x%d" % len(texts)
        a, b = simhash.simhashes([texts[0].encode(), " ".join(other).encode()])
        if int(a ^ b).bit_count() <= simhash.BITS:
            texts.append(" ".join(other))
    rows = [(i, t, None, f"s{i}", None, None) for i, t in enumerate(texts + ["short text %d of its own kind" % (i * i) for i in range(30)])]
    rows += [(None, texts[0].upper(), None, "a", None, None), (0, texts[0], None, "b", None, None), (90, None, None, "c", None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op9_packing(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    bins = [r["bin"] for r in got if r["piece_length"] == 400]
    assert len(bins) == len(set(bins)) == 14
    assert len({r["bin"] for r in got if r["bin"] is not None}) == 14


def test_lengths_in_tokens(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(1, "internationalization of words", None, "s", None, None), (2, None, None, "s", None, None)], SCHEMA)
    counted = packing.with_tokens(df, path)
    got = {r["doc_id"]: r["piece_length"] for r in packing.pack_near_copies(counted, F.col("n_tokens"), F.col("source")).collect()}
    assert got == {1: len(bpe.coder(path).encode("internationalization of words")), 2: 0} and got[1] > 3
