"""Benchmark: run the headline queries over the driver tables and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is built and executed to a no-op sink (all rows computed, nothing collected
to the driver). Three figures stand side by side: ``prepare_sec`` (gazetteer preparation,
a few small jobs on ``benchmark``), ``cold`` (the first run of each query, with code
compilation and first reads) and ``queries`` (a second run: steady state, on prepared
indexes), whose sum is ``value``. BENCH_COLD=0 leaves the first pass out.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from toponymic.session import get_session  # noqa: E402
from toponymic.plans.queries import QUERIES, inputs  # noqa: E402

HEADLINE = ["place_match", "country_match", "country_gate", "match_export", "doc_match_counts",
            "run_totals", "place_counts", "reporting_effort", "union_runs", "whole_word_filter",
            "corpus_slice", "tag_text", "page_meta", "article_meta", "tokens", "tagged_tokens", "np_candidates",
            "entity_candidates", "candidate_country_match", "candidate_place_match",
            "entity_place_match", "tagged_place_match", "token_exact_match", "ngram_match", "conversation_place_match",
            "effort_by_quality"]


def settle(spark) -> None:
    """Untimed isolation between measurements: collect the previous query's garbage
    (and let the context cleaner drop its broadcasts and shuffles) before the next one."""
    try:
        spark.sparkContext._jvm.System.gc()
    except Exception:
        pass
    time.sleep(0.5)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", app="toponymic-bench", shuffle_partitions=cpus * 2,
                        spark_driver_memory="16g")
    times: dict[str, float] = {}
    prepare = 0.0

    # Gazetteer preparation, timed on its own (small jobs on ``benchmark``).
    t0 = time.time()
    i = inputs(spark, sf_dir)
    gaz = i.gaz
    _ = gaz.lookup, gaz._places, i.nouns.count(), i.docs.columns
    prepare = round(time.time() - t0, 3)

    cold: dict[str, float] = {}
    if os.environ.get("BENCH_COLD", "1") != "0":
        for name in HEADLINE:
            t = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            cold[name] = round(time.time() - t, 3)

    for name in HEADLINE:
        settle(spark)
        t = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)

    n_docs = i.docs.count()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
        "cpus": cpus,
        "prepare_sec": prepare,
        "cold_sec": round(sum(cold.values()), 3),
        "cold": cold,
        "total_with_prepare_sec": round(total + prepare, 3),
        "documents": n_docs,
        "flagship_docs_per_sec": round(n_docs / times["place_match"], 1) if times["place_match"] else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
