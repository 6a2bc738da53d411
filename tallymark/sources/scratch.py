"""Working folders on storage that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Only where the session names no such folder, as in local tests, is a temporary folder
    chosen; on a cluster the setting is required.
    """
    base = spark.conf.get(SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {SETTING} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set(SETTING, base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
