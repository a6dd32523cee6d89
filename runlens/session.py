"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators count on. All but the first two are Spark's defaults,
# stated here because the plans rely on them.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that the cluster shares.

    The folder is the session's ``spark.checkpoint.dir``. Only a local session
    may do without it; there a temporary folder of this machine is as good.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="runlens-")
    return f"{root.rstrip('/')}/runlens/{name}-{uuid.uuid4().hex}"


def spread(scan: DataFrame) -> DataFrame:
    """Spread a scan over all cores if it has fewer than two splits per core.

    For work that is heavy per row on files that Spark can hardly split. Any input of
    some size has more splits and is left as it is read, so the exchange stays small.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < 2 * cores else scan
