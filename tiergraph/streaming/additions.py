"""Signals that arrive over time, merged add-only into a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tiergraph.operators.merge import additions
from tiergraph.sources.documents import exists


def signal_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).format(fmt).load(path)


def distinct_additions(
    stream: DataFrame, keys: Sequence[str], event_time: str | None = None,
    watermark: str | None = None,
) -> DataFrame:
    """First arrival of every key.

    Without a watermark the state holds every key ever seen. With one, repeats
    are recognised inside the watermark only and the sink's own check against
    the stored table catches the later ones, so state stays bounded.
    """
    if watermark is None:
        return stream.dropDuplicates(list(keys))
    return stream.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(list(keys))


def stored_additions(spark: SparkSession, path: str) -> DataFrame:
    """The table the stream maintains, without its batch column."""
    return spark.read.parquet(path).drop("batch")


def add_batch(batch: DataFrame, number: int, path: str, keys: Sequence[str], order: str) -> None:
    """Store the rows of one micro-batch whose keys no earlier batch has stored.

    Every batch owns the folder ``batch=<number>`` and replaces it, so a batch
    that is run again after a failure leaves the same rows behind.
    """
    spark = batch.sparkSession
    stored = batch.limit(0)
    if exists(spark, path):
        stored = spark.read.parquet(path).filter(F.col("batch") < number).drop("batch")
    fresh = additions(stored, batch, keys, order)
    fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")


def stream_additions(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    order: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Run the stream into the table at ``path``; repeats of stored keys are ignored."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, number: add_batch(batch, number, path, keys, order)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
