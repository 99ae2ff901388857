"""Session helpers: input tables, work tables in the shared folder, worker paths."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: For Python workers: freed memory goes back to the system, so that a worker that waits for its next stage holds none.
_FREEING = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": str(1 << 20), "MALLOC_MMAP_THRESHOLD_": str(1 << 20)}
#: Most rows of an Arrow batch; it bounds what a Python worker holds of long rows.
BATCH_ROWS = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver was started."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
    for name, value in _FREEING.items():
        environment.setdefault(name, value)
    # whole texts and shingle sets pass through Python in batches of so many rows
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where none is set, a temporary one of a local session."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-work-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Workspace:
    """Intermediate tables of one operator call, written to the shared folder.

    A written table cuts the lineage, survives lost executors, and is read by
    several later branches without being computed again.
    """

    def __init__(self, spark: SparkSession, label: str):
        ready(spark)
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def written(self, df: DataFrame, name: str, compression: str = "snappy", by: str | None = None) -> DataFrame:
        path = f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"
        # a written table needs its shuffles no more: they go with the execution, not when the driver happens to collect garbage
        before = self.spark.conf.get(_CLEAN)
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.parquet(path, partitionBy=by, compression=compression)
        finally:
            self.spark.conf.set(_CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._work_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for table in tables:
            self._delete(table._work_path)

    def drop_part(self, table: DataFrame, part: str) -> None:
        """Deletes a part (``column=value``) of a table written by that column."""
        self._delete(f"{table._work_path}/{part}")

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, lengthened until none is a column's, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bucket_of(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def once(docs: DataFrame, doc_id: str, repeated: DataFrame) -> DataFrame:
    """The table with one row for each id, the smallest by its columns in order; ``repeated`` holds the ids of several rows, and only their rows move."""
    (row,) = free_names(docs.columns, "row")
    several = docs.join(repeated, doc_id, "left_semi").groupBy(doc_id).agg(F.min(F.struct(*docs.columns)).alias(row)).select(f"{row}.*")
    return docs.join(repeated, doc_id, "left_anti").unionByName(several)
