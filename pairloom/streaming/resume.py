"""A scoring run that goes on where it stopped: a stream over a folder with a checkpoint, keyed output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def run_once(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, key: str) -> StreamingQuery:
    """Process the files of ``source`` that no earlier run has, append the results, and stop.

    A batch that is repeated after a failure appends only keys the sink does not hold, so every
    key is in the sink once.
    """

    def append(batch: DataFrame, number: int) -> None:
        out = work(batch.dropDuplicates([key]))
        try:
            done = spark.read.parquet(sink).select(key)
            out = out.join(done, key, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        out.write.mode("append").parquet(sink)

    query = spark.readStream.schema(schema).json(source).writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(append).start()
    query.awaitTermination()
    return query
