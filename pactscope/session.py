"""Session construction and fault-tolerant materialisation."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app_name: str = "pactscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Hot keys are expected, so skewed joins may be split even where that costs one more shuffle.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # call sites of single expressions are costly to record and not needed
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def allow_skew_splits(spark: SparkSession) -> None:
    """Let a skewed join be split even where that costs one more shuffle."""
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's setting, or a temporary one in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master == "local" or context.master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pactscope-", dir="/tmp"))
    else:
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder, for tables that cut lineage."""
    unique = spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{unique}")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and cut its lineage, so a lost executor repeats one step."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
