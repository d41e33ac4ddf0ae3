import random
import re

import pytest

from toponymic.llm import pii, queries

KEY = b"test key"
SCHEMA = "doc_id long, text string, pii_found string, __own string, __attempts int"


@pytest.mark.parametrize("text,want", [
    ("mail a.b-c+1@Mail4.example.com now", [("email", "a.b-c+1@mail4.example.com")]),
    ("élan.19@mail8.example.com.", [("email", "élan.19@mail8.example.com")]),
    ("at 182.29.63.135, 10.0.0.1. not 1.2.3.4.5 or 300.1.1.1", [("ip", "182.29.63.135"), ("ip", "10.0.0.1")]),
    ("+1 (476) 555-6291 and (476) 555-6291 or 476-555-6291", [("phone", "1|14765556291"), ("phone", "0|4765556291"), ("phone", "0|4765556291")]),
    ("card 4365873117289653 or 4111 1111 1111 1111", [("card", "4365873117289653"), ("card", "4111111111111111")]),
    ("ssn 123-45-6789", [("ssn", "123456789")]), ("2024-01-02 1234567 12.5 v1.2.3", []), ("clean words, only. Here", []),
    ("Mr. John Smith met Anna Schmidt and Frau Müller", [("name", "1|John Smith"), ("name", "|Anna Schmidt"), ("name", "0|Müller")]),
    ("Анна Иванова", [("name", "|Анна Иванова")]), ("Mr. nobody", []), ("x4365873117289653", []), ("####+1 (843) 555-7672###", [("phone", "1|18435557672")]),
])
def test_detection(text, want):
    assert [(k, n) for _, _, k, n in pii.find(text)] == want


def test_surrogates_keep_type_and_form():
    s = pii.Surrogates(KEY)
    text = "Ann.5@Mail4.example.com 182.29.63.135 10.1.2.3 +1 (476) 555-6291 4111 1111 1111 1111 4365873117289654 123-45-6789 Mrs. Jane Doe, Анна Иванова"
    new, found = pii.replace(text, s, {})
    again = pii.find(new)
    assert [k for _, _, k, _ in again] == [k for _, _, k, _ in found]
    shape = lambda t: re.sub(r"\d", "9", t)
    for (a, b, kind, normal), (c, d, _, other) in zip(found, again):
        old, fresh = text[a:b], new[c:d]
        assert old != fresh and normal != other
        if kind in ("phone", "card", "ssn"):
            assert shape(old) == shape(fresh)
    cards = [re.sub(r"\D", "", n) for _, _, k, n in again if k == "card"]
    assert pii._check(cards[0][:-1]) == int(cards[0][-1])            # a valid check digit stays valid,
    assert pii._check(cards[1][:-1]) != int(cards[1][-1])            # an invalid one invalid
    assert new[again[3 - 1][0]:].startswith("10.")                   # a private address stays private
    assert again[3][3].startswith("1|1")                             # the country code stays
    jane, anna = again[-2][3], again[-1][3]
    assert jane.partition("|")[2].split()[0] in pii.GIVEN["latin"][0]
    assert anna.partition("|")[2].split()[0] in pii.GIVEN["cyrillic"][0]
    assert re.fullmatch("[а-яА-Я]+", anna.split()[-1])
    assert pii.replace(text, pii.Surrogates(b"other"), {})[0] != new and pii.replace(text, s, {})[0] == new


def test_digits_are_permuted():
    s = pii.Surrogates(KEY)
    assert len({s._digits(f"{i:03d}", "x") for i in range(1000)}) == 1000
    assert len({s._digits(str(i), "x") for i in range(10)}) == 10
    assert len({s.of("card", f"4{i:04d}00000000{j}") for i in range(300) for j in range(10)}) == 3000
    ips = [f"10.0.{i}.{j}" for i in range(20) for j in range(20)]
    assert len({s._ip(x, "ip|0") for x in ips}) == 400


def corpus():
    rng = random.Random(6)
    rows = []
    for i in range(200):
        card = "".join(rng.choices("0123456789", k=16))
        rows.append((i, f"doc {i} mail u{i % 50}.x@mail{i % 7}.example.com card {card} from 23.{i % 200}.3.{i % 250} end", None, None, i))
    return rows + [(500, None, None, None, 1), (501, "", None, None, 1), (None, "call +1 (476) 555-6291", None, None, None),
                   (0, rows[0][1], None, None, 0), (502, "clean words " * 50000, None, None, 1)]


def test_corpus_is_distinct_and_consistent(spark, tmp_path):
    df = spark.createDataFrame(corpus(), SCHEMA)
    got = pii.surrogate_texts(df, KEY)
    assert got.columns == ["doc_id", "text", "__own", "__attempts", "pii_found"]
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    mapping, real = {}, set()
    for d, old, *_ in corpus():
        if not old:
            assert texts[d] == old
            continue
        a, b = pii.find(old), pii.find(texts[d])
        assert len(a) == len(b)
        if not a:
            assert texts[d] == old
        for (_, _, kind, x), (_, _, _, y) in zip(a, b):
            assert mapping.setdefault((kind, x), y) == y             # one surrogate wherever it stands
            real.add((kind, x))
    assert len(set(mapping.values())) == len(mapping)
    assert not real & {(k, v) for (k, _), v in mapping.items()}      # no surrogate is an entity of the corpus
    df.drop("pii_found").write.parquet(str(tmp_path / "documents.parquet"))
    r = [r for r in queries.op10_surrogates(spark, str(tmp_path)).collect() if r["doc_id"] == 7][0]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 0)


def test_collisions_are_resolved(spark, monkeypatch):
    """With a first attempt that sends many names to one, and one to another entity, all end distinct."""
    plain = pii.Surrogates.of

    def weak(self, kind, normal, attempt=0):
        if kind == "email" and attempt == 0:
            return "same@mail.example.com" if normal < "u3" else "u5.x@mail5.example.com"
        return plain(self, kind, normal, attempt)

    df = spark.createDataFrame(corpus(), SCHEMA)
    monkeypatch.setattr(pii.Surrogates, "of", weak)
    found = [("email", f"u{i}.x@mail{i}.example.com") for i in range(9)]
    s = pii.Surrogates(KEY)
    state = spark.createDataFrame([(k, n, s.of(k, n)) for k, n in found], "kind string, normal string, surrogate string")
    moved = {r["normal"]: r["attempt"] for r in pii.exceptions(state, KEY).collect()}
    final = {n: s.of("email", n, moved.get(n, 0)) for _, n in found}
    assert len(set(final.values())) == 9 and not set(final.values()) & set(final)
    assert final["u0.x@mail0.example.com"] == "same@mail.example.com"        # the first of a group keeps its own


@pytest.mark.parametrize("most", [0, 100_000])
def test_small_spaces_have_room(spark, monkeypatch, most):
    """All given names and all initials behind titles, and short addresses: each still gets a surrogate of its own."""
    monkeypatch.setattr(pii, "MOST_MOVED", most)                      # joined, or sent to all tasks
    lines = [f"{title} {n} wrote" for title, names in zip(("Mrs", "Mr"), pii.GIVEN["latin"]) for n in names[:12]]
    lines += [f"{title} {c} wrote" for title in ("Mr", "Ms") for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    lines += [f"to {c}@b.example" for c in "aeiou"]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(lines)], SCHEMA)
    got = {r["doc_id"]: r["text"] for r in pii.surrogate_texts(df, KEY).collect()}
    old, new = [[t.split(" ")[1] for t in ts] for ts in (lines, [got[i] for i in range(len(lines))])]
    assert len(set(new)) >= len(set(old)) and not set(old) & set(new)
    assert all(len({o for o, n in zip(old, new) if n == one}) == 1 for one in new)
    with_given = [(r, got[i]) for i, r in enumerate(lines[:24])]
    for line, fresh in with_given:                                                # a given name stays one of its gender
        female = line.startswith("Mrs")
        assert set(fresh.split(" ")[1].split("-")) <= set(pii.GIVEN["latin"][0 if female else 1])


def test_a_space_without_a_free_value_is_reported(spark, monkeypatch):
    monkeypatch.setattr(pii, "MOST_ATTEMPTS", 2)
    s = pii.Surrogates(KEY)
    state = spark.createDataFrame([("ssn", str(d), s.of("ssn", str(d))) for d in range(10)], "kind string, normal string, surrogate string")
    with pytest.raises(ValueError, match="no free surrogate"):
        pii.exceptions(state, KEY)


def replaced(spark, lines):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(lines)], SCHEMA)
    got = {r["doc_id"]: r["text"] for r in pii.surrogate_texts(df, KEY).collect()}
    return [got[i] for i in range(len(lines))]


def test_one_person_and_one_number_have_one_surrogate(spark):
    lines = ["Mrs Anna Berg,", "Anna Berg,", "Dr Anna Berg,", "Mr Berg,", "James Berg,", "Mr Zorblin Kraal,", "Prof Zorblin Kraal,",
             "+1 (476) 555-6291 x", "+14765556291 x", "(476) 555-6291 x", "+49 30 12345678 x", "+493012345678 x", "+4930 12345678 x"]
    # enough others for attempts, and titled names that take the surrogates of some
    lines += [f"Mr {c}," for c in "BCDFGHKLMNPRSTVZ"] + [f"Ms {c} Berg," for c in "AEIOU"]
    got = replaced(spark, lines)
    name = lambda i: got[i].partition(" ")[2]             # noqa: E731
    assert got[1] == name(0) == name(2) and got[1].split()[1] == name(3) == got[4].split()[1]
    assert name(5) == name(6) and name(5).split()[0] in pii.GIVEN["latin"][1]
    assert got[1].split()[0] in pii.GIVEN["latin"][0] and got[4].split()[0] in pii.GIVEN["latin"][1]
    digits = [re.sub(r"\D", "", t) for t in got[7:13]]
    assert digits[0] == digits[1] == "1" + digits[2] and digits[3] == digits[4] == digits[5] and digits[3].startswith("49")
    assert not {t.split(" ", 1)[1].rstrip(",") for t in lines[13:29]} & {t.split(" ", 1)[1].rstrip(",") for t in got[13:29]}


def test_an_attempt_moves_all_forms_of_an_entity(spark):
    s = pii.Surrogates(KEY)
    first = [n for n in (s.of("phone", "1|14765556291"), s.of("surname", "Berg"), s.of("name", "|Anna Berg"))]
    lines = ["+1 (476) 555-6291 x", "+14765556291 x", "476-555-6291 x", "+" + first[0][2:] + " x", "Mr Berg,", "Anna Berg,", "Mrs Anna Berg,",
             f"Mr {first[1]},"]
    got = replaced(spark, lines)
    digits = [re.sub(r"\D", "", t) for t in got[:4]]
    assert digits[0] == digits[1] == "1" + digits[2] != first[0][2:] and digits[3] != digits[0]
    assert got[5] == got[6][4:] and got[5].split()[1] == got[4][3:] != first[1] + ","


@pytest.mark.parametrize("text,want", [
    ("Mr O'Brien left", "O'Brien"), ("Mr O’Neill.", "O’Neill"), ("Anna Smith-Jones said", "Anna Smith-Jones"),
    ("Frau Müller-Lüdenscheidt", "Müller-Lüdenscheidt"), ("Mr Smith's dog", "Smith"), ("Anna Berg’s dog", "Anna Berg"),
    ("Mrs D'Angelo-O'Hara's", "D'Angelo-O'Hara"), ("'Mr Smith' and Dr Lee-", "Smith")])
def test_names_with_marks_are_whole(text, want):
    assert pii.find(text)[0][3].partition("|")[2] == want


def test_no_part_of_a_marked_name_remains(spark):
    lines = ["Mr O'Brien wrote", "Mr O'Connor wrote", "Anna Smith-Jones wrote", "Frau Müller-Lüdenscheidt wrote", "Mr Brien's wrote"]
    got = replaced(spark, lines)
    for old, new in zip(lines, got):
        assert new.endswith(" wrote")
        for part in re.findall(r"\w{3,}", old)[:-1]:
            assert part == "Frau" or part not in new
    assert got[0] != got[1] and re.fullmatch(r"Mr \w'\w{5} wrote", got[0]) and re.fullmatch(r"Mr \w{5}'s wrote", got[4])


@pytest.mark.parametrize("text,want", [
    ("said John Smith and Mary Johnson, Michael Brown.", ["|John Smith", "|Mary Johnson", "|Michael Brown"]),
    ("Anna Maria Berg, Jean-Pierre Dupont", ["|Anna Maria Berg", "|Jean-Pierre Dupont"]), ("Priya Sharma met Mehmet Yılmaz", ["|Priya Sharma", "|Mehmet Yılmaz"]),
    ("Дмитро Коваль и Ольга Петрова", ["|Дмитро Коваль", "|Ольга Петрова"]), ("محمد الأنصاري قال", ["|محمد الأنصاري"]), ("محمد قال", []),
    ("Herr 田中 und Dr محمد", ["1|田中", "|محمد"]), ("The Quick Brown fox John ran, Mary went", []), ("Mr John Smith", ["1|John Smith"]),
    ("Xanthor Smith", []), ("Zebedee Quill", [])])
def test_names_of_the_table_are_found(text, want):
    assert [n for _, _, k, n in pii.find(text) if k == "name"] == want


def test_a_table_adds_given_names(spark, monkeypatch):
    lines = ["by Xanthor Smith here", "by Mr Smith here", "by Zebedee Quill here", "by Ἀχιλλεύς Νέστωρ here", "by Nobody Known here"]
    names = spark.createDataFrame([("Xanthor", "latin", 1), ("Zebedee", "latin", 0), ("Zebedee", "latin", 1), ("Ἀχιλλεύς", "other", None), (None, None, None)],
                                  "name string, script string, gender int")
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(lines)], SCHEMA)
    got = {r["doc_id"]: r["text"].split(" ") for r in pii.surrogate_texts(df, KEY, names=names).collect()}
    assert got[0][1] in pii.GIVEN["latin"][1] and got[0][2] == got[1][2] != "Smith"
    assert got[2][1] in {*pii.GIVEN["latin"][0], *pii.GIVEN["latin"][1]} and got[2][2] != "Quill"
    assert got[3][1] != "Ἀχιλλεύς" and got[3][2] != "Νέστωρ" and got[4] == lines[4].split(" ")
    monkeypatch.setattr(pii, "MOST_NAMES", 2)
    with pytest.raises(ValueError, match="given names"):
        pii.surrogate_texts(df, KEY, names=names)


def test_empty_table(spark):
    assert pii.surrogate_texts(spark.createDataFrame([], SCHEMA), KEY).collect() == []
