"""SQL oracles (DuckDB dialect) for the registered queries.

Each oracle derives the same fixture gazetteer from the driver tables and computes the
query by a different route: tokens joined with names, and for multi-word names a
``contains`` guard plus an RE2 boundary regex (RE2 has no look-arounds, so boundaries
are written as ``(^|[^W])`` ... ``([^W]|$)``).
"""

from __future__ import annotations

W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\x0B\f\r]"

# Shared CTEs: fixture gazetteer (see toponymic.sources.fixture) and per-document words.
GAZETTEER = rf"""
btok AS (SELECT unnest(regexp_extract_all(text, '{W}+')) AS tok FROM benchmark),
country AS (
  SELECT 'N' || CAST(k AS VARCHAR) AS iso, tok AS country
  FROM (SELECT tok, row_number() OVER (ORDER BY count(*) DESC, tok) - 1 AS k
        FROM btok WHERE length(tok) BETWEEN 2 AND 5 GROUP BY tok)
  WHERE k < 25),
pname AS (
  SELECT name, row_number() OVER (ORDER BY part, name) - 1 AS row_index FROM (
    SELECT DISTINCT 0 AS part, tok AS name FROM btok WHERE length(tok) >= 6
    UNION ALL
    SELECT DISTINCT 1 AS part, unnest(regexp_extract_all(text, '{W}{{4,}} {W}{{4,}}')) AS name FROM benchmark)),
place AS (
  SELECT CAST(row_index AS BIGINT) AS row_index,
         CAST(5000000 + row_index AS BIGINT) AS geonameid,
         name, name AS asciiname,
         CAST(row_index % 180 - 90 AS DOUBLE) AS latitude,
         CAST(row_index % 360 - 180 AS DOUBLE) AS longitude,
         CAST(length(name) * 1000 + row_index AS BIGINT) AS population,
         'N' || CAST(row_index % 25 AS VARCHAR) AS countrycode
  FROM pname),
place2 AS (   -- names of two words, with both words, so that a text meets them by its words
  SELECT *, split_part(name, ' ', 1) AS w1, split_part(name, ' ', 2) AS w2 FROM place WHERE contains(name, ' '))"""

DOC_WORDS = rf"""
dt AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{W}+')) AS tok FROM documents),
hit AS (SELECT DISTINCT dt.doc_id, c.iso FROM dt JOIN country c ON dt.tok = c.country)"""


def boundary_match(text: str, name: str) -> str:
    """Guarded whole-word test of a multi-word literal name (no metacharacters)."""
    return (f"(CASE WHEN contains({text}, {name}) THEN regexp_matches({text}, "
            f"'(^|{NW})' || {name} || '({NW}|$)') ELSE false END)")


# Ungated and gated place matches over full text: one row per (doc, place row).
MATCHES = rf"""
um AS (
  SELECT dt.doc_id, p.* FROM dt JOIN place p ON dt.tok = p.name
  UNION ALL
  SELECT d.doc_id, p.* EXCLUDE (w1, w2) FROM dt JOIN place2 p ON dt.tok = p.w1
  JOIN dt d2 ON d2.doc_id = dt.doc_id AND d2.tok = p.w2
  JOIN documents d ON d.doc_id = dt.doc_id
  WHERE {boundary_match('d.text', 'p.name')}),
m AS (SELECT um.* FROM um JOIN hit h ON h.doc_id = um.doc_id AND h.iso = um.countrycode)"""


def with_ctes(*parts: str, body: str) -> str:
    return "WITH " + ",".join(p.strip("\n") for p in parts) + "\n" + body
