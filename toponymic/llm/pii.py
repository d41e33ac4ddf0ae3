"""Personal data replaced by keyed surrogates of the same type and form.

Entities: e-mail addresses, IPv4 addresses, phone numbers, card and account numbers (13 to
19 digits), social security numbers (3-2-4 digits) and personal names (after a title, or
known given names with a surname; ``given`` has the names that are known, a table can add
more). A surrogate depends on a secret key, the type and the
entity's normal form alone, so an entity has one surrogate wherever it stands:

* digits go through a keyed Feistel permutation of all numbers of their length, so two
  numbers never share a surrogate; separators, a country code and the validity of a
  card's check digit stay;
* letters become letters of the same class (vowel or not), script and case; a known given name
  becomes another of the same gender and script;
* an entity is what a reader sees: a name without its title, a number with its country code,
  however it is written (a number without one has the form of country 1). Each word of a name
  after the given name has a surrogate of its own, so 'Mr Smith' and 'James Smith' keep one
  surname. A known given name that stands alone behind a title counts as a given name.

Then the corpus is checked: an entity whose surrogate another entity shares, or whose
surrogate is itself an entity of the corpus, gets the next attempt, until none is left
(``exceptions``). From the attempt ``GROWN`` on a name or e-mail address gets longer, so a
small space (given names, initials) is never used up. Only these rare entities are sent to all tasks or, if there are many, joined
back to the documents that hold them; everything else is replaced without a join.

Defined cases: a null text stays null and has no entities; a text without entities stays
as it is; overlapping candidates go to the leftmost, then to the first type above; equal
texts get equal replacements; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import hmac
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toponymic.llm import frames, storage, texts
from toponymic.llm.given import GIVEN

KINDS = ("email", "ip", "phone", "card", "ssn", "name")
ROUNDS = 8
#: Attempts of the length of the entity; each later one is longer by a letter or a given name.
GROWN = 2
#: Digits and addresses keep their length, so a corpus may hold all of a space; this many
#: attempts fail only then.
MOST_ATTEMPTS = 100

#: Names that detection knows: script and gender (None: both). Surrogates are drawn from ``GIVEN``.
Known = dict[str, tuple[str, int | None]]


def _known() -> Known:
    known: Known = {}
    for script, both in GIVEN.items():
        for gender, names in enumerate(both):
            known |= {n: (script, None if n in known else gender) for n in names}
    return known


_GIVEN = _known()
#: Bounds of a table of further given names, under which it is sent to all tasks.
MOST_NAMES = 500_000
MOST_NAME_BYTES = 16 << 20
#: Bounds of the moved entities, under which they are sent to all tasks instead of joined to the documents.
MOST_MOVED = 100_000
MOST_MOVED_BYTES = 8 << 20

#: Letters by script: vowels, then the others. A surrogate keeps class, script and case.
_LETTERS = [("aeiou", "bcdfghklmnprstvz"), ("àáâäèéêëìíîïòóôöùúûü", "çñß"),
            ("аеиоу", "бвгдзклмнпрст"), ("αειου", "βγδζκλμνπρσ")]
_CLASS = {c: letters for pair in _LETTERS for letters in pair for c in letters}

#: Letters, with single apostrophes or hyphens between them; a possessive s is no part.
_WORD = r"[^\W\d_](?:(?:-|['’](?![sS]\b))?[^\W\d_])*"
_FIND = re.compile("|".join((
    r"(?P<email>[\w.+%-]+@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,})",
    r"(?P<ip>(?<!\w)(?<!\d\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d))",
    r"(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{3,4}[ .-]\d{4}|(?:[ .-]\d{2}){3,4}|[ .-]?\d{6,8})"
    r"|\+\d{8,15}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\d))",
    r"(?P<card>(?<!\w)(?<!\d\.)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w))",
    r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
)))
_NAME = re.compile(
    r"\b(?P<title>Mrs|Mr|Ms|Miss|Dr|Prof|Herr|Frau|Madame|Monsieur|Señora|Señor|Sra|Sr)\.? (?=(?P<titled>" + _WORD + r"(?: " + _WORD + r"){0,2}))")
#: A word that may be a given name, before another word; then the words after it.
_FIRST = re.compile(r"\b[^\W\d_a-zß-öø-ÿа-яёα-ωά-ώ](?:(?:-|['’](?![sS]\b))?[^\W\d_])*(?= [^\W\d_])")
_AFTER = re.compile(r"(?: " + _WORD + r"\b){1,4}")
_TITLES = {"Mrs": 0, "Ms": 0, "Miss": 0, "Frau": 0, "Madame": 0, "Señora": 0, "Sra": 0,
           "Mr": 1, "Herr": 1, "Monsieur": 1, "Señor": 1, "Sr": 1}
_HINT = re.compile(r"[0-9@]")

Span = tuple[int, int, str, str]        # start, end, kind, normal form
Moved = dict[tuple[str, str], tuple[int, str]]      # kind, normal form -> attempt, normal form that stands for it


def _given_in(known: Known, word: str) -> tuple[str, int | None] | None:
    """Script and gender of a given name, a compound one by its first part."""
    return known.get(word) or (known.get(word.partition("-")[0]) if "-" in word else None)


def _names(text: str, known: Known) -> Iterator[Span]:
    titled = []
    for m in _NAME.finditer(text):
        start, end = m.span("titled")
        words = text[start:end].split(" ")
        while words and words[-1][0].islower():                      # a name ends with its last capital word
            words.pop()
        words = words[:next((i for i, w in enumerate(words) if w[0].islower() or _NAME.match(w + " x")), len(words))]
        if words:
            titled.append((m.start(), start + len(" ".join(words))))
            yield start, titled[-1][1], "name", f"{_TITLES.get(m.group('title'), '')}|" + " ".join(words)
    at = end = 0                                                     # next titled name, end of the last plain one
    for m in _FIRST.finditer(text):
        if m.start() < end or not _given_in(known, m.group()):
            continue
        while at < len(titled) and titled[at][1] <= m.start():
            at += 1
        after = _AFTER.match(text, m.end())
        words = after.group()[1:].split(" ") if after else []
        n = 0                                                        # further given names, then one surname
        while n < len(words) and _follows(known, m.group(), words[n]):
            n += 1
            if not _given_in(known, words[n - 1]):
                break
        end_of = m.end() + len(" ".join(["", *words[:n]]))
        if n and not (at < len(titled) and titled[at][0] < end_of):
            end = end_of
            yield m.start(), end, "name", "|" + text[m.start():end]


def _follows(known: Known, given: str, word: str) -> bool:
    """Whether a word can follow a given name: a capital one; in a script without capitals only
    another given name, or an Arabic name with the article."""
    if given[0].isupper():
        return word[0].isupper()
    return word in known or word.startswith("\u0627\u0644") and len(word) > 3


def find(text: str, known: Known = _GIVEN) -> list[Span]:
    """Entities of a text, leftmost first, without overlaps."""
    found: list[Span] = []
    if _HINT.search(text):
        for m in _FIND.finditer(text):
            kind, value = m.lastgroup, m.group()
            normal = value.lower() if kind == "email" else value if kind == "ip" else re.sub(r"\D", "", value)
            if kind == "phone":
                normal = f"{_country(value)}|{normal}"
            found.append((m.start(), m.end(), kind, normal))
    names = [n for n in _names(text, known) if not any(s < n[1] and n[0] < e for s, e, _, _ in found)]
    return sorted(found + names) if names else found


#: Country codes of one and two digits; all others have three.
_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 "
                   "81 82 84 86 90 91 92 93 94 95 98".split())


def _country(phone: str) -> int:
    """Digits of the country code at the front of a phone number, whatever its format."""
    digits = re.sub(r"\D", "", phone)
    return next((n for n in (1, 2) if digits[:n] in _CODES), 3) if phone.startswith("+") else 0


def _parts(normal: str, known: Known) -> tuple[str, str | None, list[str]]:
    """Gender, given name and other words of a name."""
    gender, _, whole = normal.partition("|")
    words = whole.split(" ")
    return (gender, words[0], words[1:]) if len(words) > 1 or _given_in(known, words[0]) else (gender, None, words)


def checked(kind: str, normal: str, known: Known = _GIVEN) -> list[tuple[str, str]]:
    """The entities whose surrogates must be distinct for this one to be."""
    if kind != "name":
        return [(kind, normal)]
    _, given, rest = _parts(normal, known)
    return [("surname", w) for w in rest] + ([(kind, normal)] if given else [])


class Surrogates:
    """Keyed replacements of normal forms."""

    def __init__(self, key: bytes, known: Known | None = None):
        self.key = key
        self.known = known or _GIVEN
        self._orders: dict[tuple[str, int], list[str]] = {}

    def _number(self, what: str, below: int) -> int:
        return int.from_bytes(hmac.new(self.key, what.encode(), hashlib.sha256).digest()[:16], "big") % below

    def _digits(self, digits: str, label: str) -> str:
        """A keyed permutation of all digit strings of this length."""
        n = len(digits)
        if n == 1:
            return str((int(digits) + 1 + self._number(label, 9)) % 10)
        half = n // 2
        a, b = int(digits[:half]), int(digits[half:])
        sizes = [10 ** half, 10 ** (n - half)]
        for r in range(ROUNDS):
            if r % 2:
                b = (b + self._number(f"{label}|{n}|{r}|{a}", sizes[1])) % sizes[1]
            else:
                a = (a + self._number(f"{label}|{n}|{r}|{b}", sizes[0])) % sizes[0]
        return f"{a:0{half}d}{b:0{n - half}d}"

    def _letters(self, text: str, label: str, attempt: int = 0) -> str:
        letters = [c for c in text.lower() if c.isalpha()] or ["a"]
        text += "".join(letters[i % len(letters)] for i in range(attempt - GROWN + 1))
        out = []
        for i, c in enumerate(text):
            low = c.lower()
            if c.isdigit():
                new = str(self._number(f"{label}|{i}|d|{text}", 10))
            elif low in _CLASS:
                letters = _CLASS[low]
                new = letters[self._number(f"{label}|{i}|{text}", len(letters))]
                new = new.upper() if c != low and len(new.upper()) == 1 else new
            elif c.isalpha() and len(low) == 1:       # any other letter keeps its script: one of its neighbours
                near = [x for x in map(chr, range(ord(c) & ~15, (ord(c) & ~15) + 16)) if x.isalpha() and x.isupper() == c.isupper()]
                new = near[self._number(f"{label}|{i}|{text}", len(near))]
            else:
                new = c
            out.append(new)
        return "".join(out)

    def _word(self, word: str, attempt: int) -> str:
        """A word of a name; never a known given name."""
        for i in itertools.count():
            new = self._letters(word, f"surname|{attempt}|{i or ''}", attempt + i // 4)
            if not any(part in self.known for part in new.split("-")):
                return new

    def _given(self, given: str, gender: str, whole: str, attempt: int) -> str:
        """A given name: at first by a permutation of the names of its script and gender, then
        by the whole name."""
        script, of_name = _given_in(self.known, given) or ("latin" if gender and given.isascii() else None, None)
        if script not in GIVEN:
            return self._letters(given, f"given|{attempt}|{whole if attempt else ''}", attempt)
        which = script, int(gender) if gender else self._number(f"gender|{given}", 2) if of_name is None else of_name
        if which not in self._orders:
            self._orders[which] = sorted(GIVEN[script][which[1]], key=lambda n: self._number(f"given|{n}", 1 << 64))
        names = self._orders[which]
        if not attempt and given in names:
            return names[(names.index(given) + 1) % len(names)]
        names = [n for n in names if n != given]
        return "-".join(names[self._number(f"given|{attempt}|{i}|{whole if attempt else given}", len(names))]
                        for i in range(max(1, attempt - GROWN + 2)))

    def of(self, kind: str, normal: str, attempt: int = 0, moved: Moved = {}) -> str:
        """Normal form of the surrogate; ``moved`` has the attempts of a name's other words."""
        label = f"{kind}|{attempt}"
        if kind == "email":
            local, _, domain = normal.partition("@")
            host, _, top = domain.rpartition(".")
            return f"{self._letters(local, label + '|' + domain, attempt)}@{self._letters(host, label)}.{top}"
        if kind == "ip":
            return self._ip(normal, label)
        if kind == "phone":
            keep, _, digits = normal.partition("|")
            n = int(keep)
            return f"{n}|{digits[:n]}{self._digits(digits[n:], label + (digits[:n] or '1'))}"
        if kind == "card":
            body = normal[0] + self._digits(normal[1:-1], label + normal[0])
            return body + str((int(normal[-1]) - _check(normal[:-1]) + _check(body)) % 10)
        if kind == "ssn":
            return self._digits(normal, label)
        if kind == "surname":
            return self._word(normal, attempt)
        gender, given, rest = _parts(normal, self.known)
        new = [self._given(given, gender, normal.partition("|")[2], attempt)] if given else []
        return f"{gender}|" + " ".join(new + [self._word(w, moved.get(("surname", w), (0, w))[0]) for w in rest])

    def _ip(self, normal: str, label: str) -> str:
        """A permutation of all addresses, walked on until the class (private, loopback,
        multicast or other) is the same."""
        x = int.from_bytes(bytes(map(int, normal.split("."))), "big")
        want = _ip_class(x)
        while True:
            a, b = x >> 16, x & 0xFFFF
            for r in range(ROUNDS):
                if r % 2:
                    b ^= self._number(f"{label}|{r}|{a}", 1 << 16)
                else:
                    a ^= self._number(f"{label}|{r}|{b}", 1 << 16)
            x = a << 16 | b
            if _ip_class(x) == want:
                return ".".join(map(str, x.to_bytes(4, "big")))

    def shown(self, kind: str, value: str, normal: str, moved: Moved = {}) -> str:
        """The surrogate in the form of ``value``: its separators, case and grouping."""
        attempt, normal = moved.get((kind, normal), (0, normal))
        new = self.of(kind, normal, attempt, moved)
        if kind == "email":
            return "".join(n.upper() if v.isupper() and len(n.upper()) == 1 else n for v, n in zip(value, new)) \
                if len(value) == len(new) else new
        if kind == "ip":
            return new
        if kind == "name":
            return new.partition("|")[2]
        digits = iter(new.rpartition("|")[2])
        return "".join(next(digits) if c.isdigit() else c for c in value)


def _ip_class(x: int) -> int:
    a, b = x >> 24, x >> 16 & 255
    return 1 if a == 10 or (a == 172 and 16 <= b < 32) or (a == 192 and b == 168) else 2 if a in (0, 127) else 3 if a >= 224 else 0


def _check(digits: str) -> int:
    """The Luhn check digit of a number without it."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


# ---------------------------------------------------------------- the operator

def known_names(names: DataFrame) -> Known:
    """The built-in given names and those of a table: ``name``, ``script`` (one of ``GIVEN``,
    or any other, whose names get surrogates letter by letter), ``gender`` (0 female, 1 male,
    null both). Rows and bytes are counted before the table leaves the executors."""
    rows = names.where("name is not null and name <> ''").groupBy("name").agg(
        F.min("script").alias("script"), F.min("gender").alias("low"), F.max("gender").alias("high"),
        F.count_if(F.col("gender").isNull()).alias("open"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("name") + F.octet_length(F.coalesce("script", F.lit("")))), F.lit(0))).first()
    if n > MOST_NAMES or size > MOST_NAME_BYTES:
        raise ValueError(f"{n} given names of {size} bytes; at most {MOST_NAMES} of {MOST_NAME_BYTES}")
    return _GIVEN | {r["name"]: (r["script"] or "", None if r["open"] or r["low"] != r["high"] else int(r["low"])) for r in rows.collect()}


def entities(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text",
             known: Known | None = None) -> DataFrame:
    """``id_col``, ``kind``, ``normal``, ``surrogate`` (first attempt), once for each
    ``checked`` entity of each row; map-only."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)]
                          + [T.StructField(c, T.StringType()) for c in ("kind", "normal", "surrogate")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = Surrogates(key, known)
        for batch in texts.small(batches, 1):
            at, kinds, normals = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for kind, normal in sorted({c for _, _, k, n in find(text, keyed.known) for c in checked(k, n, keyed.known)}) if text else ():
                    at.append(i), kinds.append(kind), normals.append(normal)
            new = [keyed.of(k, n) for k, n in zip(kinds, normals)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()),
                 pa.array(normals, pa.string()), pa.array(new, pa.string())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def exceptions(found: DataFrame, key: bytes, names: Known | None = None) -> DataFrame | None:
    """``kind``, ``normal``, ``attempt``, ``own`` of the entities that don't take their first
    surrogate, or None if there are none. ``found``: the distinct entities with first
    surrogates (a written table). A phone number's mark of its country code and a name's gender
    are no part of what a reader sees: normal forms seen alike are one entity, for which the
    least of them stands (``own``; a number keeps its own form)."""
    def redo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = Surrogates(key, names)
        for batch in batches:
            kinds, normals, attempts = (c.to_pylist() for c in batch.columns)
            new = [keyed.of(k, n, a) for k, n, a in zip(kinds, normals, attempts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())],
                                             names=["kind", "normal", "attempt", "surrogate"])

    def seen(c: str) -> Column:
        national = (F.col("kind") == "phone") & F.col(c).startswith("0|")
        return F.when(national, F.concat(F.lit("1"), F.substring(c, 3, 99))).otherwise(F.regexp_replace(c, r"^\d*\|", ""))

    words = lambda kind: found.where(F.col("kind").isin("name", "surname")).select(       # noqa: E731
        F.lit(kind).alias("kind"), F.explode(F.split(seen("normal"), " ")).alias("shown"))
    known = found.select("kind", seen("normal").alias("shown")).union(words("name")).union(words("surname")).distinct()
    several = F.col("kind").isin("name", "phone")                     # kinds with several forms of one entity
    groups = found.where(several).groupBy("kind", seen("normal").alias("form")).agg(
        F.min(F.struct("normal", "surrogate")).alias("own")).select("kind", "form", "own.*")
    groups = storage.written(found.where(~several).select("kind", F.col("normal").alias("form"), "normal", "surrogate")
                             .unionByName(groups), "groups")
    state = groups.select("kind", "normal", F.lit(0).alias("attempt"), "surrogate")
    while True:
        shown = state.withColumn("shown", seen("surrogate"))
        real = shown.join(known, ["kind", "shown"], "left_semi").select("kind", "normal")
        first = shown.groupBy("kind", "shown").agg(F.min("normal").alias("first"), F.count("*").alias("n")).where("n > 1")
        twice = shown.join(first, ["kind", "shown"]).where("normal <> first").select("kind", "normal")
        bad = storage.written(real.unionByName(twice).distinct(), "collisions")
        if bad.isEmpty():
            break
        if state.agg(F.max("attempt")).first()[0] >= MOST_ATTEMPTS:
            kinds = sorted(r["kind"] for r in bad.select("kind").distinct().collect())
            raise ValueError(f"no free surrogate after {MOST_ATTEMPTS} attempts: {', '.join(kinds)}")
        again = (state.join(bad, ["kind", "normal"], "left_semi").select("kind", "normal", (F.col("attempt") + 1).alias("attempt"))
                 .mapInArrow(redo, "kind string, normal string, attempt int, surrogate string"))
        state = storage.written(state.join(bad, ["kind", "normal"], "left_anti").unionByName(again), "surrogates")
    own = groups.join(state.select("kind", F.col("normal"), "attempt"), ["kind", "normal"]).select(
        "kind", "form", F.col("normal").alias("own"), "attempt", seen("surrogate").alias("first"))
    moved = found.withColumn("form", seen("normal")).join(own, ["kind", "form"]).where(
        (F.col("attempt") > 0) | ((F.col("kind") == "name") & (seen("surrogate") != F.col("first"))))
    moved = storage.written(moved.select("kind", "normal", "attempt", F.when(F.col("kind") == "name", F.col("own"))
                                         .otherwise(F.col("normal")).alias("own")), "moved")
    return None if moved.isEmpty() else moved


def replace(text: str, keyed: Surrogates, moved: Moved) -> tuple[str, list[Span]]:
    """The text with surrogates, and the spans they replace."""
    found = find(text, keyed.known)
    if not found:
        return text, found
    out, at = [], 0
    for start, end, kind, normal in found:
        out.append(text[at:start])
        out.append(keyed.shown(kind, text[start:end], normal, moved))
        at = end
    return "".join(out) + text[at:], found


def _replaced(key: bytes, names: list[str], text_at: int, attempts_at: int | None, known: Known | None, everywhere: Moved = {}):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = Surrogates(key, known)
        for batch in texts.small(batches, text_at):
            items, counts = [], []
            tries = batch.column(attempts_at).to_pylist() if attempts_at is not None else [None] * batch.num_rows
            for text, own in zip(batch.column(text_at).to_pylist(), tries):
                moved = {(e["kind"], e["normal"]): (e["attempt"], e["own"]) for e in own} if own else everywhere
                new, found = replace(text, keyed, moved) if text else (text, [])
                items.append(new)
                counts.append([sum(k == kind for _, _, k, _ in found) for kind in KINDS])
            kept = [c for i, c in enumerate(batch.columns) if i != attempts_at]
            kept[text_at] = pa.array(items, pa.string())
            yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.list_(pa.int32()))], names=names)

    return run


FOUND = "pii_found"


def surrogate_texts(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text",
                    names: DataFrame | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text_col`` and ``FOUND`` (numbers of entities by ``KINDS``).

    One pass gathers the distinct entities (narrow rows) for the collision check, the
    other replaces. A column of the name ``FOUND`` is replaced. The documents are joined only with the exceptions, and only if there
    are more of them than are sent to all tasks; Spark chooses the join by their measured size. ``names``: further given names to
    detect (``known_names``).
    """
    docs = docs.drop(FOUND)
    known = None if names is None else known_names(names)
    found = storage.written(entities(docs, key, id_col, text_col, known), "entities")
    distinct = storage.written(found.select("kind", "normal", "surrogate").distinct(), "distinct")
    moved = exceptions(distinct, key, known)
    schema = T.StructType([*docs.schema.fields, T.StructField(FOUND, T.ArrayType(T.IntegerType()))])
    text_at = docs.columns.index(text_col)
    if moved is None:
        return docs.mapInArrow(_replaced(key, schema.names, text_at, None, known), schema)
    n, size = moved.agg(F.count("*"), F.sum(F.octet_length("normal") + F.octet_length("own"))).first()
    if n <= MOST_MOVED and size <= MOST_MOVED_BYTES:
        everywhere = {(r["kind"], r["normal"]): (r["attempt"], r["own"]) for r in moved.collect()}
        return docs.mapInArrow(_replaced(key, schema.names, text_at, None, known, everywhere), schema)
    own, attempts = frames.fresh(docs, "__own"), frames.fresh(docs, "__attempts")
    tries = (found.join(moved, ["kind", "normal"]).groupBy(F.col(id_col).alias(own))
             .agg(F.collect_set(F.struct("kind", "normal", "attempt", "own")).alias(attempts)))
    joined = docs.join(tries, F.col(id_col).eqNullSafe(F.col(own)), "left").select(*docs.columns, attempts)
    return joined.mapInArrow(_replaced(key, schema.names, text_at, len(docs.columns), known), schema)
