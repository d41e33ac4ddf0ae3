import hashlib
import re

import numpy as np
import pytest

from toponymic.llm import fingerprints, texts

SCHEMA = "doc_id long, text string, extra string"


def plain_shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return set()
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))}


def docs():
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(60)] + ["é", "ß𝄞", "日本"]
    out = [" ".join(rng.choice(vocab, size=n)) for n in (0, 1, 2, 4, 5, 6, 30, 200, 900)]
    return out + [None, "   \n\t ", out[7], out[8] + " tail", "x" * 5000, "\x85a b c"]


def test_word_offsets_and_hashes_match_a_regex():
    items = [(t or "").encode() for t in docs()]
    w = texts.Words(items)
    h = w.hashes()
    seen = {}
    for i, t in enumerate(items):
        want = re.findall(rb"[^\x20\x09-\x0D]+", t)
        got = [bytes(w.data[w.starts[j]:w.ends[j]]) for j in range(w.first[i], w.first[i + 1])]
        assert got == want
        for j, word in zip(range(w.first[i], w.first[i + 1]), want):
            assert seen.setdefault(word, h[j]) == h[j]      # one hash for a word wherever it stands
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("most", [1, 100, 1 << 20])
def test_sketches_hold_all_hashes_below_the_threshold(monkeypatch, most):
    monkeypatch.setattr(texts, "CHUNK_BYTES", most)
    items = [(t or "").encode() for t in docs()]
    whole = fingerprints.sketches(items, scale=1)
    for t, s in zip(docs(), whole):
        assert len(s) == len(plain_shingles(t or "", 5))
    for s, cut in zip(whole, fingerprints.sketches(items, scale=4)):
        assert (np.diff(s.astype(object)) > 0).all() if len(s) > 1 else True
        want = [int(x) for i, x in enumerate(s) if int(x) < (1 << 64) // 4 or i < fingerprints.FEW]
        assert cut.tolist() == want


def test_estimates_and_merge():
    a, b = "a b c d e f g h", "c d e f g h i j"
    s, t, u = fingerprints.sketches([a.encode(), b.encode(), b""], scale=1)
    x, y = plain_shingles(a, 5), plain_shingles(b, 5)
    assert fingerprints.likeness(s, t) == len(x & y) / len(x | y)
    assert fingerprints.containment(s, t) == len(x & y) / len(x)
    assert fingerprints.likeness(u, u) == 1 and fingerprints.likeness(s, u) == 0
    items = [" ".join(f"w{i}" for i in range(k, k + 300)).encode() for k in (0, 200)]
    p, q = fingerprints.sketches(items)
    both = fingerprints.merge(p, q)
    every = sorted({*p.tolist(), *q.tolist()})
    assert both.tolist() == [v for i, v in enumerate(every) if v < (1 << 64) // fingerprints.SCALE or i < fingerprints.FEW]
    whole = fingerprints.sketches([" ".join(f"w{i}" for i in range(n)).encode() for n in (9, 30, 400)])
    for t in (" ".join(f"w{i}" for i in range(n)) for n in (9, 30, 400)):       # a merge is the sketch of the union
        part = fingerprints.sketches([t.encode(), b"v1 v2 v3 v4 v5 v6"])
        union = np.unique(np.concatenate(fingerprints.sketches([t.encode(), b"v1 v2 v3 v4 v5 v6"], scale=1)))
        want = union[(union < np.uint64((1 << 64) // fingerprints.SCALE)) | (np.arange(len(union)) < fingerprints.FEW)]
        assert fingerprints.merge(*part).tolist() == want.tolist()
    assert [len(w) >= min(n - 4, fingerprints.FEW) for w, n in zip(whole, (9, 30, 400))] == [True] * 3


def test_a_short_text_in_a_long_one():
    words = [f"w{i}" for i in range(3000)]
    long = " ".join(words)
    for n in (1, 3, 5, 6, 10, 14, 40, 130):
        for at in range(0, 400, 20):
            short = " ".join(words[at:at + n])
            a, b = fingerprints.sketches([short.encode(), long.encode()])
            x, y = plain_shingles(short, 5), plain_shingles(long, 5)
            inside = len(x & y) / len(x)
            low = min(int(fingerprints.known_up_to(b)), (1 << 64) - 1)
            known = any(int(h) <= low for h in a)                     # else no hash of the short text can be looked up
            assert fingerprints.containment(a, b) == (inside if known else None)
            assert fingerprints.containment(a, fingerprints.merge(a, b)) in (1, None)
            if n <= 19:
                assert len(a) == len(x)                               # all shingles are in the sketch
            assert 0 <= fingerprints.likeness(a, b) <= 0.1


def test_estimates_follow_brute_force_by_length():
    """Mean error of the likeness of a text and its edited copy, by length: exact while all shingles are held."""
    rng = np.random.default_rng(11)
    for n, most in ((8, 0), (19, 0), (60, 0.13), (300, 0.07), (2000, 0.03)):
        off = []
        for _ in range(60):
            words = [f"w{i}" for i in rng.integers(0, 10 ** 6, n)]
            cut = int(rng.integers(1, n))
            a, b = " ".join(words), " ".join(words[:cut] + [f"v{i}" for i in rng.integers(0, 10 ** 6, n - cut)])
            x, y = plain_shingles(a, 5), plain_shingles(b, 5)
            p, q = fingerprints.sketches([a.encode(), b.encode()])
            off.append(abs(fingerprints.likeness(p, q) - len(x & y) / len(x | y)))
        assert np.mean(off) <= most


def test_a_short_pair_has_its_exact_shares(spark):
    rows = [(2, "a b c d e f g h i j", None), (1, "a b c d e f g h i k", None)]
    got = {r["doc_id"]: r for r in fingerprints.edited_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[2]["near_next"] == 5 / 7 and got[2]["contained_next"] == 5 / 6


def edited(rows):
    """The edited texts by the plain rule, in descending order of id, then by text."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (d, t, _) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        out.append((d, t, t[:len(t) - k] + nxt[:k], nxt))
    return out


@pytest.mark.parametrize("case", ["many", "one", "repeated", "empty"])
def test_edited_copies_in_a_ring(spark, case):
    rows = [(i * 7, t, "x") for i, t in enumerate(docs())]
    if case == "one":
        rows = rows[7:8]
    if case == "repeated":
        rows = rows + rows[3:6] + [(None, "no id a b c d e f", None), (None, None, None)]
    if case == "empty":
        rows = []
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(r) for r in fingerprints.edited_copies(df).collect()]
    want = []
    for d, t, e, nxt in edited(rows):
        p, q, n = fingerprints.sketches([t.encode(), e.encode(), nxt.encode()])
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.as_text(p), fingerprints.as_text(q),
                     fingerprints.likeness(p, q), fingerprints.likeness(p, n),
                     fingerprints.containment(p, q), fingerprints.containment(p, n)))
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    for r in got:                                       # from the returned fingerprints alone
        assert r[5] == fingerprints.likeness(fingerprints.of_text(r[3]), fingerprints.of_text(r[4]))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_fingerprints_of_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, None), (None, "a b c d e f")], "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(df).collect()}
    assert got[1] == got[None] != "" and got[2] == ""
