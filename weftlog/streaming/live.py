"""Streams: the steps of the pipe language on a streaming DataFrame, with a watermark where rows are grouped by time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..sources.catalog import Connector, shared_folder


class StreamConnector(Connector):
    """A streaming DataFrame as a collection; a time column may get a watermark."""

    kind = "stream"

    def __init__(self, frames: dict[str, DataFrame], watermark: tuple[str, str] | None = None):
        self.frames, self.watermark = frames, watermark

    def read(self, spark: SparkSession, name: str, fields: set[str] | None = None) -> DataFrame:
        df = self.frames[name]
        return df.withWatermark(*self.watermark) if self.watermark else df


def run_available(df: DataFrame, mode: str = "complete") -> DataFrame:
    """What a streaming query has made of all that is there now."""
    spark, name = df.sparkSession, f"live_{uuid.uuid4().hex}"
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", shared_folder(spark)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def tumbling(spark: SparkSession, path: str) -> DataFrame:
    """Events by type and hour, as a stream of files."""
    schema = spark.read.parquet(path).schema
    folder, _, file = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{file}*")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    engine = Engine(spark, {"s": StreamConnector({"events": stream})})
    out = run_available(engine.query("s.events | summarize n=count() by event_type, hour=bin(ts, 1h)"))
    return out.withColumn("hour", F.col("hour").cast("timestamp_ntz"))
