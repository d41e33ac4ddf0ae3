import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from toponymic.llm import rans, storage

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "  a  b\n", "a\x1cb \x85c d", "I'll don't x<|endoftext|>y <|startoftext|>", "ÀÉÎ ß ªº µ é İ ΑΣ ſ K",
         "1234 a1b2 foo,. ,.bar .,", "日本語 текст\tx", "́a a ́", "İ,", "aé́.", "ŉ ÿ. Ÿ", "word " * 3000,
         "The Quick, brown. fox,,", "x" * 300, "\n\n", "don't. can't,"]


def test_ids_are_the_library_s():
    whole, fast = Tokenizer.from_file(PATH), rans.WordIds(PATH)
    for t in [x or "" for x in TEXTS] * 2:
        assert np.frombuffer(fast.ids(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(rans, "CACHE", 4)
    whole, fast = Tokenizer.from_file(PATH), rans.WordIds(PATH)
    t = "one two three four five two one"
    assert np.frombuffer(fast.ids(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_scaled_frequencies():
    for counts in ([0] * 10, [5, 0, 0, 1], [1] * 1000, [10 ** 12] + [0] * 49407, list(range(49408))):
        freq = rans.scaled(np.array(counts))
        assert freq.sum() == 1 << rans.BITS and freq.min() >= 1
    with pytest.raises(ValueError):
        rans.scaled(np.ones((1 << rans.BITS) + 1))


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 1000, 131072, 131073, 1200001])
def test_round_trip_and_size(n):
    rng = np.random.default_rng(n)
    p = 1 / np.arange(1, 2001) ** 1.2
    p /= p.sum()
    table = rans.Table(rans.scaled((p * 1e9).astype(np.int64)))
    ids = rng.choice(2000, size=n, p=p)
    block = rans.encode(ids, table)
    assert rans.decode(block, table).tolist() == ids.tolist()
    entropy = -np.log2(table.freq[ids].astype(float) / (1 << rans.BITS)).sum() / 8
    assert len(block["words"]) <= entropy + 4 * block["lanes"] + 64
    step = rans.STEPS * block["lanes"]
    for mark in range(len(block["offsets"])):                # any checkpoint can be decoded alone
        assert rans.decode_from(block, table, mark).tolist() == ids[mark * step:(mark + 1) * step].tolist()


def test_ids_that_never_occurred_can_be_coded():
    table = rans.Table(rans.scaled(np.array([10 ** 9, 0, 0, 0])))
    ids = np.array([3, 2, 1, 0] * 50)
    assert rans.decode(rans.encode(ids, table), table).tolist() == ids.tolist()


def test_damage_is_found():
    table = rans.Table(rans.scaled(np.arange(1, 500)))
    block = rans.encode(np.random.default_rng(0).integers(0, 499, 5000), table)
    words = bytearray(block["words"])
    words[len(words) // 2] ^= 1
    for bad in ({"words": bytes(words)}, {"words": block["words"][:40]}, {"crc": [0] * len(block["crc"])}):
        with pytest.raises(ValueError):
            rans.decode(block | bad, table)


@pytest.mark.parametrize("block", [50, rans.BLOCK])
def test_files_in_order_of_ids(spark, block):
    rows = [(100 - i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (7, "again"), (7, "again"), (7, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    folder = storage.shared_folder(spark, "test")
    rans.write(storage.written(rans.tokenized(df, PATH, 1), "ids"), folder, 49408, block)
    whole = Tokenizer.from_file(PATH)
    at, want = 0, []
    ids_of = lambda t: whole.encode(t or "", add_special_tokens=False).ids + [1]
    raw = lambda t: np.array(ids_of(t), "<u4").tobytes()                            # noqa: E731
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        want.append((d, len(ids_of(t)), zlib.crc32(raw(t))))
    got = [tuple(r) for r in rans.read_digests(spark, folder).collect()]
    got.sort(key=lambda r: r[1])
    for d, start, n, _ in got:
        assert start == at
        at += n
    key = lambda r: (r[0] is not None, *map(lambda x: x or 0, r))                   # noqa: E731
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sorted([(d, n, c) for d, _, n, c in got], key=key) == sorted(want, key=key)
    back = {r["start"]: r["ids"] for r in rans.read(spark, folder).collect()}
    assert [back[s] for d, s, n, c in got if d == 100 - 12] == [ids_of(TEXTS[12])]
    files = spark.read.parquet(f"{folder}/blocks").orderBy("part", "block").collect()
    ids = [d for f in files for d in f["doc_ids"]]
    assert ids == [r[0] for r in got]                        # rising from file to file and block to block


def test_an_empty_table(spark):
    folder = rans.token_files(spark.createDataFrame([], "doc_id long, text string, part int"), PATH, 1)
    assert rans.read_digests(spark, folder).collect() == []
