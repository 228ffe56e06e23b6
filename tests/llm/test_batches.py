"""How much of a table of texts is sent to a Python worker at once."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from wayloom.llm.words import BATCH_BYTES, small_batches


def test_stages_send_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', 20000)").alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    try:
        corpus_pipeline.mask_secrets(spark, docs, "")
        got = docs.mapInArrow(sizes, "n bigint, size bigint").collect()
        assert sum(r.n for r in got) == 400
        assert max(r.size for r in got) <= BATCH_BYTES + 200_000
        spark.conf.set(name, 1000)
        small_batches(spark)
        assert spark.conf.get(name) == "1000"
    finally:
        spark.conf.set(name, before)
