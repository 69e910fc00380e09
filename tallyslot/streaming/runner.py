"""Run a streaming plan to the end of its input and keep the result as parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tallyslot.sources.workdir import fresh_folder
from tallyslot.streaming.sink import KeyedSink


def _sink(out: str, finish: Callable[[DataFrame], DataFrame] | None):
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch if finish is None else finish(batch)
        # One folder per batch: a batch that is replayed after a failure replaces its own output.
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return write


def drain(
    stream: DataFrame, label: str, mode: str, finish: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Process everything that has arrived, then return what was written, with its ``batch_id``.

    State and output live in the session's shared folder. ``finish`` is applied
    to each micro-batch as an ordinary DataFrame, for joins with stored tables.
    """
    spark = stream.sparkSession
    home = fresh_folder(spark, label)
    out = f"{home}/out"
    shape = spark.createDataFrame([], stream.schema)
    if finish is not None:
        shape = finish(shape)
    # An empty first part: a stream to which nothing came still leaves a result that can be read.
    shape.write.parquet(f"{out}/batch_id=-1")
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{home}/state")
        .trigger(availableNow=True)
        .foreachBatch(_sink(out, finish))
        .start()
    )
    query.awaitTermination()
    schema = shape.schema.add("batch_id", "long")
    return spark.read.schema(schema).option("basePath", out).parquet(out)


def kept(stream: DataFrame, label: str, keys: list[str], finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Process everything that has arrived in update mode and return the newest row of each key."""
    spark = stream.sparkSession
    home = fresh_folder(spark, label)
    shape = finish(spark.createDataFrame([], stream.schema))
    sink = KeyedSink(spark, f"{home}/out", shape.schema, keys)
    query = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", f"{home}/state")
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, number: sink.write(finish(batch), number))
        .start()
    )
    query.awaitTermination()
    return sink.read()
