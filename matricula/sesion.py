"""Spark session settings shared by tests, the bench and the driver entry point."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job in the library assumes: UTC wall clock (dates and timestamps are
# formatted as text), adaptive execution for runtime join selection / skew splitting.
AJUSTES_BASE = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


# Sizing for a large cluster (hundreds of executors, tables in the tens of TB): many initial
# shuffle partitions that AQE coalesces to ~256 MB each, skewed partitions split once they are
# 5x the median and over 512 MB, and 256 MB scan splits. Applied by ``ajustes_cluster`` only
# where the session does not set them already.
AJUSTES_CLUSTER = {
    "spark.sql.shuffle.partitions": "4000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
    "spark.sql.files.maxPartitionBytes": str(256 << 20),
}


def ajustes_cluster(spark: SparkSession) -> None:
    """Apply ``AJUSTES_CLUSTER`` where the session has no explicit value of its own."""
    conf = spark._jsparkSession.sessionState().conf()
    for k, v in AJUSTES_CLUSTER.items():
        if not conf.contains(k):  # explicitly set by the session or the cluster: keep it
            spark.conf.set(k, v)
    aplicar_ajustes(spark)


def crear_sesion(master: str = "local[8]", particiones: int = 8, memoria: str = "8g") -> SparkSession:
    """Local session for tests and the bench; on a cluster, use the cluster's session."""
    b = SparkSession.builder.master(master).appName("matricula")
    for k, v in AJUSTES_BASE.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(particiones)).config("spark.driver.memory", memoria)
    # Checkpoint files of DataFrames that are no longer referenced are removed by the cleaner.
    b = b.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    asegurar_checkpoint(spark)
    return spark


def aplicar_ajustes(spark: SparkSession) -> None:
    """Apply the runtime-settable part of AJUSTES_BASE to an existing session."""
    for k, v in AJUSTES_BASE.items():
        if k == "spark.ui.enabled":
            continue
        spark.conf.set(k, v)
    asegurar_checkpoint(spark)


def dir_checkpoint(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir`` (or the one already set)."""
    actual = spark.sparkContext.getCheckpointDir()
    if actual:
        return actual
    return spark.conf.get("spark.checkpoint.dir", None)


def asegurar_checkpoint(spark: SparkSession) -> str:
    """Return the checkpoint folder, creating a scratch one only when the session names none.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used as is; a local
    scratch folder is only made for tests and local runs where the setting is unset.
    """
    actual = dir_checkpoint(spark)
    if not actual:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        actual = tempfile.mkdtemp(prefix="matricula-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", actual)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(actual)
    return spark.sparkContext.getCheckpointDir() or actual
