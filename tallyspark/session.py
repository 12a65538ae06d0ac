"""Session helpers.

The library never creates a cluster session on its own: jobs receive the
session their platform built.  ``local_session`` exists for tests, the bench
and the smoke entry point.  ``scratch_dir`` resolves the shared folder that
lineage cuts and intermediate tables are written to: it is read from the
session's ``spark.checkpoint.dir`` and only set (to a fresh folder under
/tmp) when a session with a local master has none; on a cluster it must be set.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job here relies on.  UTC keeps day/hour buckets equal to the
# UTC calendar the usage model is defined in; AQE re-plans joins and
# coalesces shuffle partitions from runtime statistics.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tallyspark") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_required_conf(spark)
    return spark


def apply_required_conf(spark: SparkSession) -> None:
    """Set the runtime SQL settings the reports depend on (idempotent)."""
    for k, v in REQUIRED_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    On a cluster this is whatever the platform put in ``spark.checkpoint.dir``
    (a shared filesystem / object store path).  Where it is unset, a session
    with a local master gets a new folder under /tmp; on a cluster that folder
    would be another one on every machine, so the call fails.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        configured = sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tallyspark-ckpt-", dir="/tmp")
        try:
            spark.conf.set("spark.checkpoint.dir", configured)
        except Exception:  # noqa: BLE001 - some deployments reject runtime core-conf changes
            pass
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the scratch folder."""
    base = scratch_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")
