"""The writer of follow-up messages: a micro-batch that is replayed writes its own folder again, so no message is there twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from clearprose.sources.readers import EVENT, follow_up_events
from clearprose.streaming.state import with_rocksdb


def write_follow_ups(gated: DataFrame, batch_id: int, path: str) -> None:
    """Events of a micro-batch's gated replies (session, message) as JSON lines in the folder of the batch."""
    events = follow_up_events(gated.filter("message is not null"))
    events.write.mode("overwrite").json(f"{path}/batch={batch_id}")


def follow_up_sink(verdicts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the follow-ups of a stream of verdicts (streaming.reply_gate) until its input is used up."""
    with_rocksdb(verdicts.sparkSession)
    writer = verdicts.writeStream.foreachBatch(lambda df, batch_id: write_follow_ups(df, batch_id, path))
    return writer.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def follow_ups(spark: SparkSession, path: str) -> DataFrame:
    """All follow-up events written so far, with their batch."""
    return spark.read.schema(f"session string, {EVENT}, batch bigint").json(path)
