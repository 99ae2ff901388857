"""What Python workers hold is bounded."""

import pyarrow as pa
from pyspark.sql import functions as F

from clearprose import session
from clearprose.operators import extract, segment


def test_batches_of_the_lint_engine_are_bounded(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    session.ready(spark)
    size = F.arrow_udf(lambda x: pa.array([len(x)] * len(x), pa.int32()), "int")
    assert spark.range(0, 3000, 1, 1).select(size("id").alias("n")).agg(F.max("n")).first()[0] == session.BATCH_ROWS
    assert spark.sparkContext.environment["ARROW_DEFAULT_MEMORY_POOL"] == "system"


def test_sentences_without_texts(spark):
    docs = spark.createDataFrame([(1, "prose-file", "One here. Two is there.\nThree.")], "doc_id bigint, kind string, text string")
    told = [segment.sentences(extract.prose_arrays(docs), n).orderBy("sent_no").collect() for n in (-1, segment.NO_TEXTS)]
    assert [r.text for r in told[0]] == ["One here.", "Two is there.", "Three."] and [r.text for r in told[1]] == [None] * 3
    assert [r[:7] for r in told[0]] == [r[:7] for r in told[1]]
