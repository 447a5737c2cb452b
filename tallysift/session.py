"""Session defaults, the shared scratch folder and tables persisted for iterative fits."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tallysift", master: str | None = None, conf: dict | None = None) -> SparkSession:
    """Start or fetch a session; ``conf`` wins over the defaults above."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the cluster's shared checkpoint folder.

    A machine-local folder is only used when no checkpoint folder is set and the session
    is a local one, where driver and executors share the machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="run-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def persist_evenly(df: DataFrame) -> tuple[DataFrame, int]:
    """Persist a table that an iterative fit scans again and again; returns it with its row count.

    The table is evaluated once. If it came in fewer partitions than there are cores, the persisted
    rows are dealt out to all of them; else the partitions of the scan stay.
    """
    held = df.persist()
    rows = held.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if held.rdd.getNumPartitions() >= cores:
        return held, rows
    spread = held.repartition(cores).persist()
    spread.count()
    held.unpersist()
    return spread, rows
