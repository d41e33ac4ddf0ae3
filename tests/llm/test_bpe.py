import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from toponymic.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
CASES = ["", " ", "  ", "\n", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n\nb ", "I'll we've don't 's'S", "x<|endoftext|>y", "<|endoftext|>",
         "<|endoftext|> <|endoftext|>a", "1234 a1b2", "tab\tx\x0by\x85z\xa0w v​u", "\x1ca\x1f b", "日本語 текст ǅ 🙂👍🏽", "é é",
         "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ab" * 500, "....!!!???", " \r\n\r\n ", "퟿\U0010ffff", "don' t '", "The the THE"]


def cases():
    rng = random.Random(0)
    parts = [" ", "  ", "\n", "'", "s", "the", "ing", "é", "1", "!", "\t", "\xa0", "Ж", "日", "<|endoftext|>", "a" * 9, ". "]
    return CASES + ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(2000)]


def test_ids_and_texts_are_the_library_s():
    lib, own = Tokenizer.from_file(PATH), bpe.Coder(PATH)
    for text in cases():
        ids = lib.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False) == text


def test_any_ids_decode_as_in_the_library():
    lib, own, rng = Tokenizer.from_file(PATH), bpe.Coder(PATH), random.Random(1)
    for _ in range(300):
        ids = rng.choices(range(50257), k=rng.randint(1, 8)) + rng.choices(range(256), k=3)
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    with pytest.raises(KeyError):
        own.decode([60000])


def test_full_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 2)
    lib, own = Tokenizer.from_file(PATH), bpe.Coder(PATH)
    for text in cases()[:200]:
        assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids


def test_merges_against_a_plain_loop():
    own, rng = bpe.Coder(PATH), random.Random(2)
    for _ in range(300):
        ids = [own.byte_id[b] for b in bytes(rng.choices(b"theinga rd", k=rng.randint(1, 30)))]
        want = list(ids)
        while True:
            known = [(own.merges[a << 20 | b] >> 20, i) for i, (a, b) in enumerate(zip(want, want[1:])) if a << 20 | b in own.merges]
            if not known:
                break
            _, i = min(known)
            want[i:i + 2] = [own.merges[want[i] << 20 | want[i + 1]] & 0xFFFFF]
        assert own.merge(list(ids)) == want


def test_operators_and_query(spark, tmp_path):
    rows = [(i, t, "x") for i, t in enumerate(CASES)] + [(None, "no id", None), (900, None, None), (0, CASES[0], "x"), (901, "long word " * 30000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    tokens = bpe.encode(df, PATH)
    back = bpe.decode(tokens, PATH).collect()
    assert sorted((str(r[0]), r[1]) for r in back) == sorted((str(r[0]), r[1] or "") for r in rows)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    lib = Tokenizer.from_file(PATH)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(str(d), len(ids := lib.encode(t or "", add_special_tokens=False).ids), sha(",".join(map(str, ids))), sha(t or ""))
            for d, t, _ in rows]
    got = [(str(r[0]), *r[1:]) for r in queries.op8_byte_bpe(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    assert bpe.decode(bpe.encode(df.limit(0), PATH), PATH).collect() == []
