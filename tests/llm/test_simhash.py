import random
import re

import numpy as np
import pytest
import xxhash

from toponymic.llm import queries, simhash

SCHEMA = "doc_id long, text string, fp string, __fp long, kept string"


def plain_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else \
        [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values, bits=2):
    """Smallest index that each index reaches by links of ``bits`` bits or fewer."""
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def corpus(rng):
    vocab = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(40):
        base = rng.choices(vocab, k=rng.randint(40, 300))
        rows.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 4])):            # near copies and copies
            near = list(base)
            if rng.random() < 0.7:
                near[rng.randrange(len(near))] = "changed"
            rows.append(" ".join(near).upper() if rng.random() < 0.3 else "  ".join(near))
    return rows + ["", None, " \n", "one", "ONE", "one two", "x y z", "É a b", "é a b", "w " * 5000]


def test_fingerprints_against_plain_python(monkeypatch):
    rows = corpus(random.Random(0))
    want = [plain_fingerprint(t) for t in rows]
    for most in (1, 1000, 1 << 20):
        monkeypatch.setattr(simhash.texts, "CHUNK_BYTES", most)
        assert simhash.simhashes([(t or "").encode() for t in rows]).tolist() == want


@pytest.mark.parametrize("make", [simhash._by_pairs, simhash._by_flips])
def test_links_inside_a_list(make):
    rng = random.Random(4)
    for _ in range(30):
        base, free = rng.getrandbits(64) & ~0xFF00FF, [0, 1, 2, 3, 4, 5, 6, 7, 16, 17, 18, 19, 20]
        values = list({base | sum(1 << b for b in rng.sample(free, rng.randint(0, 6))) for _ in range(60)})
        got, want = make(np.array(values, dtype=np.uint64), 2).tolist(), plain_components(values)
        assert all(got[x] == x for x in got)                  # a member stands for each component
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def components_of(spark, values, bits=2):
    rows = [(i, v - (1 << 64) if v >= 1 << 63 else v) for i, v in enumerate(values)]
    marked = spark.createDataFrame(rows, "id long, fp long")
    return {r["id"]: r["label"] for r in simhash._labelled(marked, "id", bits).collect()}


def test_components_of_chains_and_dense_groups(spark):
    rng = random.Random(7)
    values = []
    at = rng.getrandbits(64)
    for _ in range(40):                                       # a chain: neighbours at 2 bits, ends far apart
        values.append(at)
        at ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    center = rng.getrandbits(64)
    values += list({center ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a, 64, 5)})    # one dense ball
    values += [rng.getrandbits(64) for _ in range(200)] + [0, 3, 7, 1 << 63, (1 << 64) - 1]
    values = list(dict.fromkeys(values))
    got = components_of(spark, values)
    want = plain_components(values)
    groups = {}
    for i, w in enumerate(want):
        groups.setdefault(w, set()).add(got[i])
    assert all(len(g) == 1 for g in groups.values())          # one label in each component
    assert len({min(g) for g in groups.values()}) == len(groups)


def test_long_lists_need_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRED", 2)
    base = random.Random(3).getrandbits(64)
    values = list({base ^ (a << 8) ^ (b << 40) for a in range(0, 256, 3) for b in (0, 1, 3, 255)})
    got, want = components_of(spark, values), plain_components(values)
    assert len(set(got.values())) == len(set(want))


def test_query_and_stage(spark, tmp_path):
    rows = [(3 * i % 101, t) for i, t in enumerate(corpus(random.Random(1)))]
    rows = rows[:90] + [(500, rows[0][1]), (None, rows[1][1]), (None, "only here without an id"), (None, "ONLY here without an id"),
                        (rows[2][0], rows[2][1]), (rows[3][0], "another text of the same id")]
    data = [(d, t, "a", 1, "b") for d, t in rows]
    df = spark.createDataFrame(data, SCHEMA)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    want = plain_components([plain_fingerprint(t) for _, t in rows])
    groups = {}
    for i, w in enumerate(want):
        groups.setdefault(w, []).append(i)
    least = {w: min((rows[i][0] for i in g if rows[i][0] is not None), default=None) for w, g in groups.items()}
    expected = sorted((str(rows[i][0]), f"{plain_fingerprint(rows[i][1]):016x}", str(least[want[i]])) for i in range(len(rows)))
    got = queries.op5_simhash(spark, str(tmp_path))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got.collect()) == expected

    kept = simhash.without_near_duplicates(df)
    assert kept.schema == df.schema
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(found) == len(groups)
    at = {}
    for i, r in enumerate(rows):
        at.setdefault(r, want[i])
    assert sorted(at[f] for f in found) == sorted(groups)     # one row of each group
    assert sorted(str(f[0]) for f in found) == sorted(str(x) for x in least.values())


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).collect() == []
    assert simhash.without_near_duplicates(df).collect() == []
