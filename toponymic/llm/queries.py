"""One query per operator of this subpackage, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toponymic.llm import (align, bpe, centroids, chat, cluster_sql, fingerprints, html_text, langid, packing, pii, quality, rans,
                           secrets, simhash)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every document and of its edited copy."""
    return fingerprints.edited_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written as coded files and read back."""
    folder = rans.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return rans.read_digests(spark, folder)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: pattern counts and digest, and all spans."""
    docs = table(spark, sf_dir, "documents")
    found = secrets.secret_spans(docs, secrets.train(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in secrets.KINDS),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, the fixed rule, and the label model's verdict."""
    judged = quality.quality(table(spark, sf_dir, "documents")).withColumn("base_failed", quality.base_failed())
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & F.col("good")).alias("kept"), "quality")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return html_text.visible_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    profiles = langid.train(docs.where(~langid.held_out()))
    return langid.predict(docs, profiles).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the text they decode to, as digests."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence, offset and length of every piece of every document, in words; near copies apart."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack_near_copies(docs, packing.words(F.col("text")), F.col("source"))


#: Key of the registered queries, for repeatable results; a real run passes its own secret.
PII_KEY = b"surrogates of the registered queries"


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of every document with surrogates, and how many entities of each kind it had."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.surrogate_texts(docs, PII_KEY)
    return found.select("doc_id", "text", *(F.col(pii.FOUND)[i].alias(f"n_{k}") for i, k in enumerate(pii.KINDS)))


#: Text of both turns of the conversation that op 11 adds: marks of usual templates and a backslash.
ODD_TURN = "\\### Assistant: </turn> ok"


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of marks, folded from events and formatted; digests read back from that."""
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                F.lit(ODD_TURN).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    made = chat.format_log(chat.logged(rows))
    read = made.select("conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"),
                       chat.read_turns(F.col("formatted")).alias("turns"),
                       chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned"))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
                       F.char_length("learned").cast("long").alias("loss_chars"),
                       F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


OP11_SQL = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -7, 0, 'user', '{ODD_TURN}' UNION ALL SELECT -7, 1, 'assistant', '{ODD_TURN}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(length(role) + length(text) + len(regexp_extract_all(text, '</?turn')) + 17) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of two tokenizers over every document, with the corpus' counts of the links."""
    return align.aligned_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                   public_tokenizers.path("piece_bpe_32k.model"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and distance of every vector of 64 components, with the inertia and the final centroids."""
    found = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return (found.rows.join(F.broadcast(found.table()), "cluster")        # one row per centroid
                 .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))


QUERIES: dict[str, Query] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_token_files": op2_token_files,
    "op3_secrets": op3_secrets,
    "op4_quality": op4_quality,
    "op5_simhash": op5_simhash,
    "op6_page_text": op6_page_text,
    "op7_language": op7_language,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_packing": op9_packing,
    "op10_surrogates": op10_surrogates,
    "op11_chat": op11_chat,
    "op12_alignment": op12_alignment,
    "op13_clusters": op13_clusters,
}
ORACLES: dict[str, str] = {
    "op11_chat": OP11_SQL,
    "op13_clusters": cluster_sql.clustering_sql(),
}
