"""Exactly-once output of a stream of outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def write_outcomes(outcomes: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """One Parquet folder a micro-batch, named after it: a batch that is run again replaces its own output."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    stream = outcomes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (stream.trigger(**trigger) if trigger else stream).start()


def read_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("basePath", folder).parquet(f"{folder}/batch=*").drop("batch")
