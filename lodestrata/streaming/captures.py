"""Captures as a stream: new files of records become rows of the flat tables as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import nested


def node_stream(spark: SparkSession, folder: str, late: str = "30 days") -> DataFrame:
    """Nodes of captures in a folder of Parquet files, each record of a capture once within the watermark.

    A capture that came again with the same record gives its nodes once; the state that knows it is dropped when
    the watermark on its arrival has passed.
    """
    schema = spark.read.parquet(folder).schema
    captures = spark.readStream.schema(schema).parquet(folder).withWatermark("received_at", late)
    # the state holds a hash of each record, not the record
    captures = captures.withColumn("__digest", F.xxhash64("record")).dropDuplicatesWithinWatermark(["capture_id", "__digest"])
    return nested.triples(captures, "capture_id", "record", scalars=False).select("capture_id", "grp", "node_path", "parent_path", "ordinal")


def write(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
