"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: AQE for runtime re-planning and skew splitting,
# runtime bloom filters for the shuffle-join fallback of the name index.
_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "toponymic",
                shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Return the active session as it is, or build one with the defaults above.

    On a cluster the session already exists and carries its own settings, which nothing
    here changes. ``master`` is used for local runs (tests, bench).
    """
    live = SparkSession.getActiveSession()
    if live is not None:
        return live
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in _DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only when it is unset on a local master (tests)
    is a fresh scratch folder created and registered with the session; on a cluster an
    unset setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.sparkContext.getCheckpointDir()
        except Exception:   # no driver-side context
            configured = None
    if configured:
        return configured
    master = spark.conf.get("spark.master", "") or ""
    if not master.startswith("local"):
        # a machine-local folder is not shared by a cluster's executors and driver restarts
        raise ValueError("set spark.checkpoint.dir to a shared folder for this cluster")
    local = tempfile.mkdtemp(prefix="toponymic-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    try:
        spark.sparkContext.setCheckpointDir(local)
    except Exception:
        pass
    return local
