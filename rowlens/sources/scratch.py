"""Folder for checkpoints and intermediate tables that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir.

    Where none is named, a local session gets a fresh temporary one; a cluster has to name its own,
    since a folder of one machine would be lost with it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="rowlens-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the checkpoint folder that no other run uses."""
    return f"{checkpoint_root(spark).rstrip('/')}/rowlens-{uuid.uuid4().hex}/{name}"
