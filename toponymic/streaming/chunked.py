"""The chunked corpus run (S7, M5) as a bounded file stream.

The reference walks the corpus in chunks of 10,000 articles and writes one CSV per
chunk with running totals. Here a file-source stream reads at most ``files_per_chunk``
new files per micro-batch, ``trigger(availableNow=True)`` drains the folder and stops,
and ``foreachBatch`` runs the ordinary batch matcher on each micro-batch and writes
that chunk's CSV. The matcher is stateless per file, so no state store is needed.

The gazetteer is prepared once, outside the batches (its country list is inlined into
the plan). The streaming checkpoint (under ``spark.checkpoint.dir``) records which files
each batch took, whatever their age, so a restarted run continues where it stopped. It
belongs to one run id, input and output; the id with another input or output is refused.
Each chunk's output and totals are written idempotently (one folder per batch id,
overwritten if that batch runs again), and the run's totals are the sum over all its
chunks, those of earlier calls included.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from toponymic.operators.match import Gazetteer
from toponymic.operators.report import export_matches
from toponymic.plans.jobs import match_corpus
from toponymic.session import checkpoint_dir
from toponymic.sources.articles import META_FIELDS, article_docs, article_paths, article_reader, with_path
from toponymic.sources.sinks import chunk_path, read_csv, run_stamp, write_csv

#: Age in days beyond which the file source would pass over a file: more than any file's.
MAX_FILE_AGE = "36500d"

_TOTALS = "chunk long, output string, articles_processed long, articles_with_match long, total_matches long"
_OWNER = "input string, output string"


@dataclass
class RunTotals:
    """A1 over the whole run: articles in the corpus, articles processed (with or without
    matches), articles with a match, total matches, and the outputs written."""
    articles_total: int = 0
    articles_processed: int = 0
    articles_with_match: int = 0
    total_matches: int = 0
    chunks: list[str] = field(default_factory=list)
    new_chunks: list[str] = field(default_factory=list)     # written by this call

    @property
    def percent_complete(self) -> float | None:
        return round(100 * self.articles_processed / self.articles_total, 2) if self.articles_total else None


def _claim(spark: SparkSession, path: str, article_root: str, out_dir: str) -> None:
    """Binds a checkpoint to its input and output, or refuses another pair."""
    mine = (article_root.rstrip("/"), out_dir.rstrip("/"))
    try:
        owner = spark.read.schema(_OWNER).json(path).first()
    except AnalysisException:       # not claimed yet
        owner = None
    if owner is None:
        spark.createDataFrame([mine], _OWNER).coalesce(1).write.mode("overwrite").json(path)
    elif tuple(owner) != mine:
        raise ValueError(f"this run id belongs to input {owner['input']} and output {owner['output']}")


def run_chunked(spark: SparkSession, article_root: str, gaz: Gazetteer, out_dir: str,
                files_per_chunk: int = 10_000, tag: str = "p", on: str = "text",
                prefix: str = "", checkpoint: str | None = None, ext: str = ".nxml",
                run_id: str | None = None) -> RunTotals:
    """Run (or resume) the chunked job. ``run_id`` names the run's output folder and, by
    default, its checkpoint; passing the id of an interrupted run resumes it: batches the
    checkpoint has committed are skipped, and a batch that was cut short is re-run and
    overwrites its own chunk folder."""
    stamp = run_id or run_stamp()
    ckpt = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/stream-{prefix}{stamp}"
    _claim(spark, f"{ckpt.rstrip('/')}-owner", article_root, f"{out_dir.rstrip('/')}/{prefix}")
    _ = gaz.lookup  # prepare the gazetteer once, on the driver, before any batch
    run_folder = chunk_path(out_dir, stamp, 0, prefix).rpartition("/")[0]
    new_chunks: list[str] = []

    def one_chunk(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        docs_seen, matched = Observation(f"docs_{batch_id}"), Observation(f"matches_{batch_id}")
        docs = article_docs(batch, tag).observe(docs_seen, F.count(F.lit(1)).alias("n"))
        matches = match_corpus(docs, gaz, on=on, keep=tuple(META_FIELDS))
        export = export_matches(matches).observe(matched, F.count(F.lit(1)).alias("n"))
        # overwrite: a batch re-run after a restart replaces its own partial output
        path = write_csv(export, chunk_path(out_dir, stamp, batch_id + 1, prefix), mode="overwrite")
        # distinct documents with a match, from the chunk just written (matches only)
        with_match = read_csv(session, path, export.schema).select("doc_id").distinct().count()
        row = (batch_id + 1, path, docs_seen.get["n"], with_match, matched.get["n"])
        session.createDataFrame([row], _TOTALS).coalesce(1).write.mode("overwrite") \
            .json(f"{run_folder}/totals/chunk-{batch_id + 1}")
        new_chunks.append(path)

    stream = with_path(article_reader(spark, ext, stream=True, maxFilesPerTrigger=files_per_chunk,
                                      maxFileAge=MAX_FILE_AGE).load(article_root))
    query = (stream.writeStream
                   .foreachBatch(one_chunk)
                   .option("checkpointLocation", ckpt)
                   .trigger(availableNow=True)
                   .start())
    query.awaitTermination()
    totals = RunTotals(articles_total=article_paths(spark, article_root, ext).count(), new_chunks=new_chunks)
    try:
        rows = spark.read.schema(_TOTALS).json(f"{run_folder}/totals/*").orderBy("chunk").collect()   # a row per chunk
    except AnalysisException:       # an empty corpus has no chunk
        rows = []
    for r in rows:
        totals.articles_processed += r["articles_processed"]
        totals.articles_with_match += r["articles_with_match"]
        totals.total_matches += r["total_matches"]
        totals.chunks.append(r["output"])
    return totals
