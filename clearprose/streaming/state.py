"""What keyed streams share: the state store, and running a stream until its input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

from clearprose.session import shared_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(grouped, processor: StatefulProcessor, output: str, time_mode: str = "None", frames: bool = True) -> DataFrame:
    """Rows of a processor with a state for each key.

    It takes and gives pandas frames, or plain rows without ``frames``: a frame costs more than the rows of a small key.
    """
    run = grouped.transformWithStateInPandas if frames else grouped.transformWithState
    return run(statefulProcessor=processor, outputStructType=output, outputMode="Append", timeMode=time_mode)


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """Keyed state with several variables needs this store; a stream takes it up when it starts."""
    spark.conf.set(PROVIDER, ROCKSDB)
    return spark


def drained(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows of a stream once all its input that is there has gone through, from a Parquet sink in the shared folder.

    With the same ``folder`` a later call goes on where the last one ended.
    """
    spark = with_rocksdb(stream.sparkSession)
    folder = folder or shared_folder(spark, "stream")
    # state with a lifetime would ask for batches without rows for ever
    before = spark.conf.get(NO_DATA)
    spark.conf.set(NO_DATA, "false")
    try:
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/rows")
        query.awaitTermination()
    finally:
        spark.conf.set(NO_DATA, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
