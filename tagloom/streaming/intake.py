"""Intake of new rows as a stream: each micro-batch appends the rows whose key the table does not have yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tagloom.operators.queue import appended


def intake(spark: SparkSession, source: str, schema: str, target: str, keys: list[str], arrival: list[str], checkpoint: str) -> StreamingQuery:
    """Reads Parquet files that arrive in ``source`` and appends their new rows to the Parquet table ``target``, then ends.

    A batch that is run again after a failure adds nothing twice: its keys are there already.
    """

    def add(batch: DataFrame, _: int) -> None:
        known = spark.read.schema(batch.schema).parquet(target)
        appended(known, batch, keys, arrival).write.mode("append").parquet(target)

    spark.createDataFrame([], schema).write.mode("append").parquet(target)
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
