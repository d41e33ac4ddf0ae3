"""Alignment of two tokenizers: against whole-text encodings and counts by plain loops."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from toponymic.llm import align, texts
from toponymic.llm.bpe import byte_symbols

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["plain words here", "a", " ", "  ", " lead", "trail ", "two  blanks", "tab\tand\nlines\n\n x", "naïve café – ₤5",
       "👩‍👩‍👧 family 日本語のテキスト", "▁ mark", "x▁y", "<s> and <|endoftext|> </s> <0x0A>", "\x00\x1f ctrl \x85 next",
       "é combining ‍ ﬁ", "мир 🌍 world", "", None, "a" * 300, "日" * 50, "\n", "x \n y", " wide　blank ok",
       "\U0010ffff\U000e0001 tags", "don't we'll 123 4567,89", "ab " * 40]


@pytest.fixture(scope="module")
def brute():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    back = {c: b for b, c in byte_symbols().items()}
    strings = {i: bytes(back[c] for c in s) if set(s) <= set(back) else s.encode() for s, i in a.get_vocab().items()}
    b = sentencepiece.SentencePieceProcessor(model_file=B)

    def piece(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def ends(parts):
        at, out = 0, []
        for p in parts:
            at += len(p)
            out.append(at)
        return out

    def groups(text):
        """Groups of a text from its whole encodings and the bytes of the tokens alone."""
        if not text:
            return []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bx, by = [strings[i] for i in x], [piece(i) for i in y]
        if not b"".join(bx) == b"".join(by) == (" " + text).encode():
            return []
        ex, ey, out, i, j = ends(bx), ends(by), [], 0, 0
        for end in sorted(set(ex) & set(ey)):
            out.append((x[i:ex.index(end) + 1], y[j:ey.index(end) + 1]))
            i, j = ex.index(end) + 1, ey.index(end) + 1
        return out

    def corpus(items):
        every = [groups(t) for t in items]
        links = [Counter((x, y) for g in one for x in g[0] for y in g[1]) for one in every]
        n = Counter(pair for one in links for pair in one)
        best = defaultdict(int)
        for (x, _), count in n.items():
            best[x] = max(best[x], count)
        for one, link in zip(every, links):
            digest = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in one)
            yield (sum(len(g[0]) for g in one), sum(len(g[1]) for g in one), len(one), sum(link.values()),
                   hashlib.sha256(digest.encode()).hexdigest() if one else "",
                   sum(k for p, k in link.items() if n[p] == best[p[0]]), sum(k * n[p] for p, k in link.items()))

    return corpus


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


def result(spark, items, **more):
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(items)], "doc_id long, text string, pair string, n long")
    found = align.aligned_documents(rows, A, B, **more)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    return {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in found.collect()}


def fuzzed(n):
    rnd = random.Random(5)
    alphabet = ["a", "b", "the", " ", " ", "  ", "\n", "\t", "é", "日", "👩", "‍", "1", "23", ".", ",", "'s", "<s>",
                "ing", "tion", "X", "_", "ß", "́", " ", "ﬁ", "Ω", "\\"]
    return ["".join(rnd.choices(alphabet, k=rnd.randint(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("head", [align.HEAD, 40, 0])
def test_equals_whole_encodings_at_any_head(spark, brute, head):
    items = ODD + fuzzed(300) + ODD
    want = dict(enumerate(brute(items)))
    assert result(spark, items, head=head) == want
    if head == 0:
        assert any(w[0] for w in want.values()) and any(w[0] == 0 for w in want.values())


def test_documents_equal_brute_force(spark, brute):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").toPandas()
    items = docs["text"].tolist()
    assert result(spark, items) == dict(enumerate(brute(items)))


def test_long_texts_in_pieces_and_small_caches(monkeypatch, brute):
    monkeypatch.setattr(texts, "CHUNK_BYTES", 50)
    monkeypatch.setattr(align, "CACHE", 4)
    tool = align.Aligner(A, B)
    items = [*fuzzed(60), "one two  three " * 30, "x" * 500, " y" * 90, *ODD]
    found = [doc.row()[:5] for doc in tool.documents([t or "" for t in items], 20)]
    assert found == [w[:5] for w in brute(items)]


def test_group_with_many_links_counts_distinct_pairs_only():
    left, right = [1 << 2, 2 << 2] * 5000, [3 << 2 | 2] * 7000
    left[-1] |= 1
    right[-1] |= 1
    code = np.array(left + right + [1 << 2 | 1, 3 << 2 | 3], np.uint32)
    keys, times, n = align.linked(code, np.zeros(len(code), np.int64))
    assert keys.tolist() == [1 << 20 | 3, 2 << 20 | 3] and times.tolist() == [5000 * 7000 + 1, 5000 * 7000]
    assert n.tolist() == [[10001, 7001, 2, 10000 * 7000 + 1]]


def test_nulls_repeats_and_empty_table(spark, brute):
    rows = spark.createDataFrame([(None, "same text"), (None, "same text"), (1, None), (1, "same text")], "doc_id string, text string")
    found = align.aligned_documents(rows, A, B).collect()
    want = list(brute(["same text"] * 3 + [None]))
    assert sorted(tuple(r[c] for c in COLUMNS) for r in found) == sorted(want)
    assert align.aligned_documents(rows.limit(0), A, B).count() == 0
    blank = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert {tuple(r[c] for c in COLUMNS) for r in align.aligned_documents(blank, A, B, head=0).collect()} == {(0, 0, 0, 0, "", 0, 0)}
