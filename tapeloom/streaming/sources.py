"""Stream sources and sinks shared by the live jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tapeloom import contracts
from tapeloom.sources import lake

FLUSH_INTERVAL = "5 minutes"


def read_files(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None,
               fmt: str = "parquet") -> DataFrame:
    """A folder of landed files as a stream, oldest file first."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def start(writer: DataStreamWriter, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Start on a cadence, or drain what is available when none is given."""
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def drain(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process everything available and stop."""
    query = start(writer, checkpoint)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def lake_sink(stream: DataFrame, root: str, table: str, source: str) -> DataStreamWriter:
    """Checked append to a lake table; exactly once, a flush per trigger.

    Started with :data:`FLUSH_INTERVAL` the most a crash can delay is one
    interval, and nothing is lost.
    """
    rows = contracts.conform(lake.stamp(stream, source), table)
    return (
        rows.writeStream.format("parquet").outputMode("append")
        .partitionBy("date").option("compression", "zstd")
        .option("path", lake.table_path(root, table))
    )


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Run a batch plan on every micro-batch."""
    return stream.writeStream.foreachBatch(handle)


def batch_table(root: str, name: str, batch_id: int) -> str:
    """Output folder of one micro-batch; a retry overwrites the same folder."""
    return f"{root.rstrip('/')}/{name}/batch_id={batch_id}"


def write_batch(df: DataFrame, root: str, name: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(batch_table(root, name, batch_id))


def read_batches(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """All micro-batch outputs of ``name``, none yet included."""
    path = f"{root.rstrip('/')}/{name}"
    if not lake.exists(spark, path):
        return spark.createDataFrame([], schema + ", batch_id int")
    return spark.read.schema(schema + ", batch_id int").parquet(path)
