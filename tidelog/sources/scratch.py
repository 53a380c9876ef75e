"""Paths for intermediate files: in the folder of ``spark.checkpoint.dir``, which driver and executors share. Only a local session, whose
executors are the driver, gets one of its own where that is unset."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidelog-"))
        base = sc.getCheckpointDir()
    if ":" not in base.split("/")[0]:
        base = "file://" + os.path.abspath(base)
    return f"{base.rstrip('/')}/tidelog/{name}-{uuid.uuid4().hex}"
