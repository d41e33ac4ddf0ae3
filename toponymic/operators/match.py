"""Whole-word matching of countries and places, gated by country.

Plan of the full-text match, per document row and in one stage (no shuffle):

1. ``words``  = distinct word runs of the text (computed once).
2. ``isos``   = countries named in the text. The country table is small and size-checked,
   so it is inlined as a literal array: a hash intersection with the row's words finds
   the anchored countries, and only multi-word names run a regex on the text.
3. ``explode(words)`` equi-joins the place index on ``anchor``, broadcast behind a size
   check (rows and bytes). Above it, the tokens are first semi-joined with the broadcast
   set of distinct anchors and the join shuffles on the anchor, with AQE skew splitting.
4. The gate (``array_contains(isos, countrycode)``) and the exactness check for
   multi-word names (second word run among the row's words, then the name as a
   substring, then the boundary regex) are the join condition, evaluated while the text
   is still in the row. Units without a country are not exploded at all.

Above the broadcast bound only ``(unit, token, isos)`` rows are shuffled on the token. Names
of one run are settled there; for the others the candidates ``(unit, place)`` meet each
text once, by the unit's key, so no text is ever copied for its tokens.

A country table above the literal bound falls back to row-wise country hits and a
semi-join on ``(doc_id, iso)``, which the planner shuffles on both keys.

The same operators serve candidate phrases (entities, noun phrases): the unit of
matching becomes ``(doc_id, cand_id)`` with the phrase as its text, and the gate uses the
countries found in any phrase of the same document.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toponymic.functions.text import span_cand_id, span_phrase, spans_words
from toponymic.functions.words import distinct_word_runs, trigrams, word_windows
from toponymic.operators.long_texts import ROW, exploded_pieces
from toponymic.operators.names import (MAX_LITERAL_NAMES, boundary, broadcast_if_bounded, collect_bounded, ends_index, ends_key,
                                       fits_broadcast, gram_index, literal_array, name_index)

PLACE_COLS = ["row_index", "geonameid", "name", "asciiname", "latitude", "longitude",
              "population", "countrycode"]

_COUNTRY_ENTRY = T.StructType([
    T.StructField("iso", T.StringType()),
    T.StructField("anchor", T.StringType()),
    T.StructField("single", T.BooleanType()),
    T.StructField("guard", T.StringType()),
    T.StructField("pattern", T.StringType()),
])


def _exact(entry, patterns: bool = False) -> Column:
    """Exactness check after the anchor join, cheapest test first (And/Or short-circuit in
    generated code): one-run names are settled by the anchor; others need their second
    run among the row's words, then the guard substring, then the boundary regex."""
    text = F.col("text")
    second_ok = entry("second").isNull() | F.array_contains(F.col("words"), entry("second"))
    guarded = second_ok & F.contains(text, entry("guard"))
    if patterns:    # without the boundaries first: they are tried at every character, a pattern's first letter seldom fits
        guarded = guarded & F.regexp_like(text, entry("body"))
    return entry("single") | (guarded & F.regexp_like(text, boundary(entry("body"))))


def _phrase_words(phrase: Column) -> Column:
    """Word set of a chunker phrase. The chunker joins whole tokens (maximal word runs or
    single marks) with single spaces, so splitting on ' ' yields every word run of the
    phrase (plus marks and '', which never equal an anchor): the regex's set, for less."""
    return F.array_distinct(F.split(phrase, " "))


class CountryLookup:
    """A bounded country table inlined into the plan, evaluated per text row."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: (r["iso"], r["pattern"]))
        self.entries = literal_array(rows, _COUNTRY_ENTRY)
        anchors = sorted({r["anchor"] for r in rows if r["anchor"] is not None})
        self.unanchored = any(r["anchor"] is None for r in rows)
        self.anchors = (F.array(*[F.lit(a) for a in anchors]) if anchors else F.array()).cast("array<string>")

    def hit(self, words: Column) -> Column:
        """Anchors of this country list among a row's distinct words (hash intersection)."""
        return F.array_intersect(words, self.anchors)

    def isos(self, texts: Column, hit: Column) -> Column:
        """ISO codes of the countries named in any element of ``texts``.

        ``hit`` is ``self.hit(words)`` computed in an earlier projection; it is referenced
        twice here so the optimizer keeps it there instead of inlining it into the
        per-country lambda (which would redo the intersection for every country).
        """
        def named(c: Column) -> Column:
            anchored = c["anchor"].isNull() | F.array_contains(hit, c["anchor"])
            in_text = F.exists(texts, lambda t: (c["guard"].isNull() | F.contains(t, c["guard"]))
                               & F.regexp_like(t, c["pattern"]))
            return anchored & (c["single"] | in_text)

        found = F.array_distinct(F.transform(F.filter(self.entries, named), lambda c: c["iso"]))
        worth = F.size(hit) >= 0 if self.unanchored else F.size(hit) > 0
        return F.when(worth, found).otherwise(F.array().cast("array<string>"))


@dataclass
class _Index:
    """A name index split into the anchored part (joined) and the rest (checked by regex)."""
    anchored: DataFrame          # broadcast-hinted when its size is proven small
    broadcast: bool
    anchor_set: DataFrame | None  # distinct anchors, broadcast, when the index itself is not
    residual: DataFrame          # names without an anchor
    residual_rows: list | None   # the same, inlined when bounded
    payload: list[str]
    grams: "_Index | None" = None       # patterns without an anchor, joined on a required trigram
    gram_list: list | None = None       # those trigrams, inlined when bounded
    patterns: bool = False              # the names of this part are such patterns
    ends: DataFrame | None = None       # patterns of whole words, joined on the characters at their ends
    end_sizes: list | None = None       # their numbers of words, and of characters of either end in their keys

    @classmethod
    def build(cls, index: DataFrame, payload: list[str], patterns: bool = False) -> "_Index":
        # The index is small (gazetteer-sized) and read by every query's broadcast:
        # keep it materialized instead of re-deriving it each time (recomputed from
        # lineage if an executor holding it is lost).
        index = index.persist(StorageLevel.MEMORY_AND_DISK)
        anchored = index.where(F.col("anchor").isNotNull()).select("anchor", "second", "single", "guard", "body",
                                                                   *payload)
        small = fits_broadcast(anchored)
        anchor_set = None
        if not small:
            # Too big to ship whole: ship only its distinct anchors, so the text side is
            # cut down to tokens that can match before it is shuffled on the token.
            anchors = anchored.select(F.col("anchor").alias("__key")).distinct()
            anchor_set = F.broadcast(anchors) if fits_broadcast(anchors) else None
        residual = index.where(F.col("anchor").isNull())
        if patterns:
            ends = ends_index(index, payload).persist(StorageLevel.MEMORY_AND_DISK)
            sizes = sorted(map(tuple, ends.select("n_words", "n_lead", "n_tail").distinct().collect()))  # bounded by the sizes' bounds
            if sizes:
                whole = cls.build(index.join(broadcast_if_bounded(ends.select("body").distinct()), "body", "left_anti"),
                                  payload, patterns)
                whole.ends, whole.end_sizes = broadcast_if_bounded(ends), sizes
                return whole
        if patterns and not residual.isEmpty():
            split = gram_index(index).persist(StorageLevel.MEMORY_AND_DISK)
            keyed = split.where(F.col("gram").isNotNull())
            whole = cls.build(index.where(F.col("anchor").isNotNull())
                                   .unionByName(split.where(F.col("gram").isNull()).drop("gram")), payload)
            whole.patterns = True
            if not keyed.isEmpty():
                whole.grams = cls.build(keyed.withColumn("anchor", F.col("gram")).withColumn("second", F.lit(None).cast("string"))
                                             .withColumn("single", F.lit(False)).drop("gram"), payload)
                whole.grams.patterns = True
                rows = collect_bounded(keyed.select("gram").distinct())
                whole.gram_list = None if rows is None else sorted(r["gram"] for r in rows)
            return whole
        return cls(F.broadcast(anchored) if small else anchored, small, anchor_set, residual,
                   collect_bounded(residual, MAX_LITERAL_NAMES), payload)


class Gazetteer:
    """Places and countries prepared for matching.

    ``places`` needs the ``PLACE_COLS``; ``countries`` needs an ISO code and a name
    (``iso_col`` / ``name_col``). Preparing the indexes runs small jobs on the gazetteer
    only (row bounds, the inlined country list); the corpus is not touched.
    """

    def __init__(self, places: DataFrame, countries: DataFrame, regex_names: bool = False,
                 iso_col: str = "iso", name_col: str = "country"):
        self.places = places
        self.countries = countries.select(F.col(iso_col).alias("iso"), F.col(name_col).alias("country"))
        self.regex_names = regex_names
        self._prepared: dict = {}

    def prepared(self, key, make):
        """A table derived from the gazetteer, made (and sized) once."""
        if key not in self._prepared:
            self._prepared[key] = make()
        return self._prepared[key]

    # ---------------------------------------------------------------- indexes
    @cached_property
    def _country_index(self) -> DataFrame:
        return name_index(self.countries, "country", self.regex_names)

    @cached_property
    def lookup(self) -> CountryLookup | None:
        """The inlined country list, or None above ``MAX_LITERAL_NAMES`` rows."""
        entries = self._country_index.select("iso", "anchor", "single", "guard",
                                             boundary(F.col("body")).alias("pattern"))
        rows = collect_bounded(entries, MAX_LITERAL_NAMES)
        return None if rows is None else CountryLookup(rows)

    @cached_property
    def _countries(self) -> _Index:
        return _Index.build(self._country_index, ["iso"], self.regex_names)

    @cached_property
    def _places_per_country(self) -> list | None:
        """(countrycode, n) rows of the gazetteer, bounded like the country list."""
        per_country = self.places.groupBy("countrycode").agg(F.count(F.lit(1)).alias("n"))
        return collect_bounded(per_country, MAX_LITERAL_NAMES)

    @cached_property
    def _places(self) -> _Index:
        return _Index.build(name_index(self.places.select(*PLACE_COLS), "name", self.regex_names), PLACE_COLS,
                            self.regex_names)

    @cached_property
    def longest_name(self) -> int:
        """Characters of the longest place or country name."""
        names = self.places.select(F.col("name").alias("n")).unionByName(self.countries.select(F.col("country").alias("n")))
        return names.agg(F.max(F.char_length("n"))).first()[0] or 0

    # ---------------------------------------------------------------- units
    def text_units(self, docs: DataFrame, text_col: str = "text", key: str = "doc_id",
                   carry: tuple[str, ...] = ()) -> DataFrame:
        """One row per document: doc_id, text, words, (when inlined) isos, and the
        ``carry`` columns (document metadata that rides along to the matches). ``key`` tells
        the units of one gate apart; where it takes several columns, pass a struct of them."""
        base = docs.select(F.col(key).alias("doc_id"), F.col(text_col).alias("text"), *carry)
        base = base.select("doc_id", "text", *carry, distinct_word_runs("text").alias("words"))
        if self.lookup is not None:
            base = base.select("*", self.lookup.hit(F.col("words")).alias("__hit"))
            base = base.select(*[c for c in base.columns if c != "__hit"],
                               self.lookup.isos(F.array(F.col("text")), F.col("__hit")).alias("isos"))
        return base

    def candidate_docs(self, cands: DataFrame, any_tokens: bool = False) -> DataFrame:
        """One row per document: doc_id, its other columns, ``spans`` (the chunker's coded
        spans) and, when the country list is inlined, ``isos``: the countries named in any
        of its phrases, found in the row before exploding. ``any_tokens``: the tokens come from
        another tokenizer, so one may hold several word runs."""
        per_doc = cands
        if self.lookup is not None:
            phrases = F.transform("spans", span_phrase)
            words = distinct_word_runs(F.array_join(phrases, "\n")) if any_tokens else spans_words(F.col("spans"))
            per_doc = per_doc.select("*", self.lookup.hit(words).alias("__hit"))
            per_doc = per_doc.select(*[c for c in per_doc.columns if c != "__hit"],
                                     self.lookup.isos(phrases, F.col("__hit")).alias("isos"))
        return per_doc

    @staticmethod
    def candidate_units(per_doc: DataFrame, keep: tuple[str, ...] = (), gate: bool = False,
                        any_tokens: bool = False) -> DataFrame:
        """One row per phrase: doc_id, cand_id, text (the phrase), words[, isos], keep.
        Spans are decoded after the explode, in generated code. With ``gate`` the phrases
        of a document without any country are left out before the explode."""
        inline = "isos" in per_doc.columns
        cols = ["doc_id", *keep] + (["isos"] if inline else [])
        spans = F.when(F.size("isos") > 0, F.col("spans")) if gate and inline else F.col("spans")
        units = (per_doc.select(*cols, F.explode_outer(spans).alias("s"))
                        .where(F.col("s").isNotNull())
                        .select(*cols, span_cand_id(F.col("s")).alias("cand_id"),
                                span_phrase(F.col("s")).alias("text")))
        return units.select("*", (distinct_word_runs("text") if any_tokens else _phrase_words(F.col("text"))).alias("words"))

    @staticmethod
    def phrase_units(cands_long: DataFrame) -> DataFrame:
        """Units from long candidates (doc_id, cand_id, phrase), e.g. from supplied tags.

        There is no per-document country set here, so ``places_in`` gates with a join on
        ``(doc_id, iso)`` instead of the in-row check.
        """
        return cands_long.select("doc_id", "cand_id", F.col("phrase").alias("text"),
                                 distinct_word_runs("phrase").alias("words"))

    # ---------------------------------------------------------------- matching
    def countries_in(self, units: DataFrame) -> DataFrame:
        """Distinct (doc_id, iso) named in the units.

        ``units`` is a text-unit table or a candidate-doc table (one row per document).
        """
        if "isos" in units.columns:
            return (units.select("doc_id", F.explode_outer("isos").alias("iso"))
                         .where(F.col("iso").isNotNull()))
        if "spans" in units.columns:
            units = self.candidate_units(units)
        return self._hits(units, self._countries).select("doc_id", "iso").distinct()

    def places_in(self, units: DataFrame, gate: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
        """Place rows named in each unit (J3 / J5): one row per (unit, place row), with
        the unit's ``keep`` columns."""
        keys = [k for k in ("doc_id", "cand_id") if k in units.columns]
        inline_gate = gate and "isos" in units.columns
        hits = self._hits(units, self._places, gate_col="isos" if inline_gate else None, keep=keep)
        if gate and not inline_gate:
            found = self.countries_in(units).withColumnRenamed("doc_id", "__doc")
            hits = hits.join(found, hits.doc_id.eqNullSafe(found["__doc"]) & (hits.countrycode == found.iso),
                             "left_semi")
        return hits.select(*keys, *keep, *PLACE_COLS)

    def piece_units(self, docs: DataFrame, size: int, text_col: str = "text", key: str = "doc_id",
                    carry: tuple[str, ...] = ()) -> DataFrame:
        """Text units of the pieces of long texts (see ``operators.long_texts``): ``doc_id`` is the number of the text,
        ``__doc`` its key."""
        if self.regex_names:
            raise ValueError("names that are patterns have no longest form: texts can't be cut")
        overlap = self.longest_name + 1
        pieces = exploded_pieces(docs.select(F.col(key).alias("__doc"), F.col(text_col).alias("text"), *carry), "text",
                                 max(size, overlap), overlap)
        return self.text_units(pieces, key=ROW, carry=("__doc", *carry))

    def countries_in_pieces(self, units: DataFrame) -> DataFrame:
        """Distinct (doc_id, iso) over all pieces of a text; ``doc_id`` is the number of the text."""
        return self.countries_in(units).distinct()

    def places_in_pieces(self, units: DataFrame, gate: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
        """``places_in`` of the whole texts, from their pieces: a place is reported once a text, and the gate knows the
        countries of all pieces. Only hits are shuffled, never a text."""
        hits = self._hits(units, self._places, keep=("__doc", *keep)).dropDuplicates(["doc_id", "row_index"])
        if gate:
            found = self.countries_in_pieces(units).select(F.col("doc_id").alias("__text"), "iso")
            hits = hits.join(found, (F.col("doc_id") == F.col("__text")) & (F.col("countrycode") == F.col("iso")), "left_semi")
        return hits.select(F.col("__doc").alias("doc_id"), *keep, *PLACE_COLS)

    def gate_counts(self, units: DataFrame) -> DataFrame | None:
        """J2 summary per document in one pass: places the gate admits (gazetteer rows of
        the document's countries), ungated and gated place matches; zero rows kept.

        The admitted count is computed in the row from a per-country count map (bounded
        like the country list); a left-outer broadcast join keeps documents without any
        hit, and one aggregation per document follows. Returns None when a bound does not
        hold (callers then combine ``countries_in`` and ``places_in``).
        """
        counts = self._places_per_country
        if (counts is None or "isos" not in units.columns or self._places.residual_rows is None
                or self._places.grams is not None or self._places.ends is not None):
            return None
        counts = sorted((r["countrycode"], r["n"]) for r in counts if r["countrycode"] is not None)
        count_map = (F.map_from_arrays(F.array(*[F.lit(c) for c, _ in counts]),
                                       F.array(*[F.lit(n).cast("long") for _, n in counts]))
                     if counts else F.create_map().cast("map<string,bigint>"))
        admitted = F.aggregate("isos", F.lit(0).cast("long"),
                               lambda acc, iso: acc + F.coalesce(F.element_at(count_map, iso), F.lit(0).cast("long")))
        exact = _exact(F.col)
        # computed in its own projection: expressions listed next to a generator are
        # evaluated above it, once per exploded row
        per_doc = units.select("doc_id", "text", "isos", "words", admitted.alias("n_admitted"))
        if not self._places.broadcast:      # the join below would shuffle whole texts
            return None
        tokens = per_doc.select("doc_id", "text", "isos", "words", "n_admitted",
                                F.explode_outer("words").alias("__tok"))
        joined = tokens.join(self._places.anchored, (F.col("__tok") == F.col("anchor")) & exact, "left")
        hit = F.col("row_index").isNotNull()
        gated = hit & F.array_contains("isos", F.col("countrycode"))
        out = joined.select("doc_id", "n_admitted", hit.cast("long").alias("u"), gated.cast("long").alias("g"))
        if self._places.residual_rows:
            extra = self._hits(units, self._places, keep=("isos",))
            out = out.unionByName(extra.select(
                "doc_id", F.lit(0).cast("long").alias("n_admitted"), F.lit(1).cast("long").alias("u"),
                F.array_contains("isos", F.col("countrycode")).cast("long").alias("g")))
        return out.groupBy("doc_id").agg(F.max("n_admitted").alias("n_admitted"),
                                         F.sum("u").alias("n_ungated"), F.sum("g").alias("n_gated"))

    @staticmethod
    def _hits(units: DataFrame, index: _Index, gate_col: str | None = None,
              keep: tuple[str, ...] = ()) -> DataFrame:
        keys = [k for k in ("doc_id", "cand_id") if k in units.columns] + list(keep)
        carry = list(dict.fromkeys(keys + ["text", "words"] + ([gate_col] if gate_col else [])))
        text = F.col("text")

        def gate(entry) -> Column:
            return F.array_contains(F.col(gate_col), entry("countrycode")) if gate_col else F.lit(True)

        # explode_outer: a plain explode makes the optimizer infer size(words) > 0 and
        # push it below the projection, which would tokenize every text twice; the
        # null token of an empty array simply finds no join partner. For the same reason
        # a unit that the gate leaves without any country loses its words here, in the
        # generator's input, and not in a filter.
        words = F.when(F.size(gate_col) > 0, F.col("words")) if gate_col else F.col("words")
        if index.broadcast:
            tokens = units.select(*carry, F.explode_outer(words).alias("__tok"))
            out = (tokens.join(index.anchored, F.col("__tok") == F.col("anchor"))
                         .where(gate(F.col) & _exact(F.col, index.patterns))
                         .select(*keys, *index.payload))
        else:
            out = _shuffled_hits(units, index, words, gate, keys, [gate_col] if gate_col else [])

        if index.ends is not None:
            out = out.unionByName(_window_hits(units, index, words, gate, keys, [gate_col] if gate_col else []))
        if index.grams is not None:
            # patterns meet the texts that hold their trigram; a unit that the gate leaves out is not read
            grams = trigrams(text)
            grams = F.array_distinct(grams) if index.gram_list is None else \
                F.array_intersect(grams, F.array(*map(F.lit, index.gram_list)))
            grams = F.when(F.size(gate_col) > 0, grams) if gate_col else grams
            out = out.unionByName(Gazetteer._hits(units.withColumn("words", grams), index.grams, gate_col, keep))
        if index.residual_rows is None:
            # Too many unanchored names to inline: an exact nested-loop theta join.
            extra = units.select(*carry).join(
                index.residual, gate(F.col) & F.regexp_like(text, boundary(F.col("body"))))
            return out.unionByName(extra.select(*keys, *index.payload))
        if index.residual_rows:
            schema = T.StructType([f for f in index.residual.schema.fields
                                   if f.name in index.payload + ["guard", "body"]])
            names = literal_array(index.residual_rows, schema)
            extra = units.select(*carry, F.explode_outer(F.filter(
                names, lambda e: gate(lambda c: e[c]) & F.regexp_like(text, boundary(e["body"])))).alias("__e"))
            extra = extra.where(F.col("__e").isNotNull())
            out = out.unionByName(extra.select(*keys, *[F.col("__e")[c].alias(c) for c in index.payload]))
        return out


def _shuffled_hits(units: DataFrame, index: _Index, words: Column, gate, keys: list[str],
                   gate_cols: list[str]) -> DataFrame:
    """Hits when the index is too big to broadcast: tokens are shuffled without their text.

    A unit is known by its keys and a hash of its text, so units that share a key are
    told apart; units equal in both are one text, and each of them keeps its own tokens.
    """
    ids = [k for k in ("doc_id", "cand_id") if k in units.columns] + ["__text"]
    marked = units.withColumn("__text", F.xxhash64("text"))
    carried = list(dict.fromkeys(keys + ids + gate_cols))
    tokens = marked.select(*carried, F.explode_outer(words).alias("__tok"))
    if index.anchor_set is not None:
        tokens = tokens.join(index.anchor_set, F.col("__tok") == F.col("__key"), "left_semi")
    found = tokens.join(index.anchored, F.col("__tok") == F.col("anchor")).where(gate(F.col))
    settled = found.where(F.col("single")).select(*keys, *index.payload)
    open_ = found.where(~F.col("single")).select(*carried, "second", "single", "guard", "body", *index.payload)
    texts = marked.select(*[F.col(i).alias(f"__{i}") for i in ids], "text", "words") \
                  .dropDuplicates([f"__{i}" for i in ids])
    same = [F.col(i).eqNullSafe(F.col(f"__{i}")) for i in ids]
    checked = open_.join(texts, same).where(_exact(F.col, index.patterns))
    return settled.unionByName(checked.select(*keys, *index.payload))


def _window_hits(units: DataFrame, index: _Index, words: Column, gate, keys: list[str], gate_cols: list[str]) -> DataFrame:
    """Hits of the patterns of whole words: a word, or several that follow each other, meets the patterns with its
    ends and is matched as a whole.

    Words travel without their text. Several words of a unit may match a pattern, so hits are reduced to one
    for each unit and pattern; the number of the unit's row tells units with the same key apart.
    """
    ids = [k for k in ("doc_id", "cand_id") if k in units.columns]
    carried = list(dict.fromkeys([ROW] + ids + keys + gate_cols))
    longer = sorted({n for n, _, _ in index.end_sizes} - {1})
    if longer:
        windows = F.array_distinct(F.concat(*[word_windows(F.col("text"), n) for n in longer]))
        words = F.concat(words, F.when(F.size(gate_cols[0]) > 0, windows) if gate_cols else windows)
    tokens = (units.withColumn(ROW, F.monotonically_increasing_id())
                   .select(*carried, F.explode_outer(words).alias("__tok")))
    word = F.col("__tok")
    made = F.array(*[ends_key(word, word, F.lit(n), F.lit(m)) for n, m in sorted({s[1:] for s in index.end_sizes})])
    tokens = tokens.select(*carried, "__tok", F.explode(made).alias("__key"))
    found = (tokens.join(index.ends, F.col("__key") == F.col("anchor"))
                   .where(gate(F.col) & word.startswith(F.col("lead")) & word.endswith(F.col("tail"))
                          & F.regexp_like(word, F.concat(F.lit("^(?:"), F.col("body"), F.lit(")$")))))
    return (found.select(*dict.fromkeys([ROW] + ids + keys), "body", "nth", *index.payload)
                 .dropDuplicates([ROW, *ids, "body", "nth"]).select(*keys, *index.payload))


def _by_length(docs: DataFrame, text_col: str, split_over: int) -> tuple[DataFrame, DataFrame]:
    """Rows with texts of up to ``split_over`` bytes, and the others."""
    long = F.coalesce(F.octet_length(text_col) > split_over, F.lit(False))
    return docs.where(~long), docs.where(long)


def countries_in_text(docs: DataFrame, gaz: Gazetteer, text_col: str = "text", split_over: int | None = None) -> DataFrame:
    """(doc_id, iso) named in each text (J1). ``split_over``: see ``places_in_text``."""
    if split_over is None:
        return gaz.countries_in(gaz.text_units(docs, text_col))
    short, long = _by_length(docs, text_col, split_over)
    units = gaz.piece_units(long, split_over, text_col)
    keys = units.select("doc_id", "__doc").distinct()
    found = gaz.countries_in_pieces(units).join(keys, "doc_id").select(F.col("__doc").alias("doc_id"), "iso")
    if gaz.lookup is None:      # the join form reports a country once a key, also for rows that share it
        return gaz.countries_in(gaz.text_units(short, text_col)).unionByName(found).distinct()
    return gaz.countries_in(gaz.text_units(short, text_col)).unionByName(found)


def places_in_text(docs: DataFrame, gaz: Gazetteer, text_col: str = "text", gate: bool = True,
                   keep: tuple[str, ...] = (), split_over: int | None = None) -> DataFrame:
    """Place rows named in each text (J3), gated by country.

    ``split_over``: texts of more bytes are cut into pieces of about as many characters,
    which many tasks match; the rows are the same. Such texts are found by a scan of their own,
    so the texts are read twice: worth it where single documents hold up a job.
    """
    if split_over is None:
        return gaz.places_in(gaz.text_units(docs, text_col, carry=keep), gate=gate, keep=keep)
    short, long = _by_length(docs, text_col, split_over)
    found = gaz.places_in(gaz.text_units(short, text_col, carry=keep), gate=gate, keep=keep)
    return found.unionByName(gaz.places_in_pieces(gaz.piece_units(long, split_over, text_col, carry=keep), gate, keep))
