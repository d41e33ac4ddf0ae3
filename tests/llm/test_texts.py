import numpy as np

from toponymic.llm import bpe, langid, rans, secrets, simhash, texts


def test_pieces_lose_nothing():
    for text in ("", "a", "a b  c", "abc " * 50, "x" * 500, " lead and tail "):
        for most in (1, 3, 10, 1000):
            got = list(texts.pieces(text, most))
            assert "".join(got) == text
            assert all(p.startswith(" ") for p in got[1:])


def test_hashes_do_not_depend_on_the_stretches(monkeypatch):
    rng = np.random.default_rng(0)
    text = " ".join(["w" * int(n) for n in rng.integers(1, 90, 500)] + ["y" * 200, "zz"]).encode()
    w = texts.Words([text, b"", text[:300]])
    monkeypatch.setattr(texts, "_LONG_WORD", 64)
    want = {}
    for stretch in (1 << 20, 1000, 100):
        monkeypatch.setattr(texts, "_STRETCH", stretch)
        texts._powers.cache_clear()
        for a, b, h in zip(w.starts, w.ends, w.hashes()):
            assert want.setdefault(w.data[a:b].tobytes(), h) == h
    texts._powers.cache_clear()
    assert len(set(want.values())) == len(want)


def test_a_very_long_text_is_handled_in_pieces(monkeypatch):
    """Small pieces and one piece give equal results in every operator."""
    rng = np.random.default_rng(1)
    text = " ".join("".join(rng.choice(list("abcdeé"), size=rng.integers(1, 9))) for _ in range(4000)) + ". End\n tail"
    import public_tokenizers
    coder = bpe.Coder(public_tokenizers.path("byte_bpe_50k.json"))
    words = rans.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    profiles = langid.Profiles({"x": langid.counted([text[:500]])[0][0][:50].tolist()})

    def results():
        full, n = langid.counted([text])[0]
        return (coder.encode(text), coder.encode(text.replace("\n", "")), words.ids(text), full.tolist(), n.tolist(),
                profiles.predict([text]), secrets._transitions(text.encode()).tolist(), simhash.simhashes([text.encode()]).tolist())

    want = results()
    monkeypatch.setattr(texts, "CHUNK_BYTES", 500)
    monkeypatch.setattr(simhash, "TALLIED", 37)
    assert results() == want


def test_cache_keeps_what_is_used():
    cache = texts.Cache(8)
    for i in range(100):
        if cache.young.get("often") is None and cache.get("often") is None:
            assert i == 0
            cache.put("often", 1)
        cache.put(i, i)
        assert len(cache.young) + len(cache.old) <= 8
