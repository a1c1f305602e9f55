"""Session helpers: a local session for tests and benches, and the checkpoint folder rule."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

KEYS = ["recording", "interval_id", "channel"]


def local_session(cores: str = "*", app: str = "pulsegrid", partitions: int = 8, **conf: str) -> SparkSession:
    """Session for one machine. On a cluster, pass the cluster's own session to the operators instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that ``DataFrame.checkpoint`` writes to.

    ``spark.checkpoint.dir`` wins. Without it a temporary folder is used in local mode only: on a cluster a
    machine-local folder would not outlive its executor, so a missing setting is an error there.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        configured = tempfile.mkdtemp(prefix="pulsegrid-checkpoints-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()
