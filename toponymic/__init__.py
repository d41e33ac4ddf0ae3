"""Gazetteer matching over document corpora, expressed as Spark DataFrame jobs.

Sub-packages:

* ``sources``   – readers for articles, gazetteers and country tables, the CSV sink,
                  and the fixture gazetteer derived from the driver tables.
* ``functions`` – column expressions: word boundaries, markup extraction, tokens and tags.
* ``operators`` – the matchers (text, candidates, exact tokens, n-grams), candidate
                  phrase builders and the report aggregations.
* ``plans``     – composite jobs and the registry of named queries with their SQL oracles.
* ``streaming`` – the chunked corpus run as a bounded file stream.
"""

from toponymic.session import get_session, checkpoint_dir  # noqa: F401
