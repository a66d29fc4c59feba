"""What a session needs to run the library's Python functions on this machine."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Let Python workers on this machine import the library; a cluster gets it by --py-files."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), ROOT) if x)


def workspace(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a local run (tests) gets a temporary folder; a cluster,
    whose machines share none, an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "tariffloom-shared")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
