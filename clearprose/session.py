"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: For Python workers: freed memory goes back to the system.
_FREEING = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": str(1 << 20), "MALLOC_MMAP_THRESHOLD_": str(1 << 20)}
#: Most rows of an Arrow batch; it bounds what a Python worker holds of whole texts and their sentences.
BATCH_ROWS = 512


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package wherever the driver was started, and bounds what they hold."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
    for name, value in _FREEING.items():
        environment.setdefault(name, value)
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return spark


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder's name in the one that spark.checkpoint.dir names; a local session without it takes a temporary one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-work-")
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
