"""Cleaning and packing of a corpus: five stages over ``documents``.

Every stage takes what its predecessor kept and returns it with the columns of
``documents``; the last returns the packed pieces. ``run`` writes the result of each
stage to the cluster's shared folder and rereads it, so a lost executor repeats one stage
at most. No stage drops a row but by its own verdict: rejected quality, no known
language, or a near-duplicate of a row that stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toponymic.llm import langid, packing, pii, quality, simhash, storage

#: Key of the surrogates; a real run sets ``spark.toponymic.pii.key``.
PII_KEY = "surrogates of the corpus pipeline"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rule and the label model accept."""
    return quality.good_documents(docs)


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents written in a language learned from the labelled ones."""
    return langid.known_language(docs, langid.train(docs))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (3-word shingles, 2 bits)."""
    return simhash.without_near_duplicates(docs, size=3, bits=2)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced and ``n_chars`` counted again."""
    key = spark.conf.get("spark.toponymic.pii.key", PII_KEY).encode()
    replaced = pii.surrogate_texts(docs, key).drop(pii.FOUND)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        replaced = replaced.withColumn("n_chars", F.length("text").cast(kind))
    return replaced.select(*docs.columns)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequence, offset and length, in words, of every piece of every document."""
    text = F.col("text")
    return packing.pack(docs, packing.words(text), F.col("source"), packing.exact_copies(text))


STAGES = [
    ("quality", quality_rules),
    ("language", known_languages),
    ("simhash", simhash_dedup),
    ("surrogates", surrogates),
    ("packing", best_fit),
]

#: Label models, links and bins are not SQL: tests hold the rows against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = storage.written(stage(spark, docs, sf_dir), name)
    return docs
