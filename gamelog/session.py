"""Session helpers: a builder for local runs, and where checkpoints may go."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench. Clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gamelog")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # Split a skewed join even when that costs one more shuffle: a join that feeds a
        # window on the same key would otherwise keep the hot key in one task.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def require_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    On a cluster it must be configured (``spark.checkpoint.dir``), because a folder
    on one machine dies with it. A local session without one gets a fresh folder.
    """
    context = spark.sparkContext
    configured = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = tempfile.mkdtemp(prefix="gamelog-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{require_checkpoint_dir(spark)}/gamelog-{uuid.uuid4().hex}"


def find_package(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it.

    Needed where the path is known to the driver's process only; a cluster that ships the
    package itself is not disturbed.
    """
    root, environment = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def stored(df: DataFrame) -> DataFrame:
    """The rows written once to the shared checkpoint folder, read back without lineage."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let the shuffle files of plans that nothing refers to any more go now.

    Spark deletes them once the driver's garbage collector has found the plan unused, which can
    be long after the disk is full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
