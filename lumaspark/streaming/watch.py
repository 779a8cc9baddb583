"""Folders of images as streams.

The operators on files handle one file at a time, so they run unchanged on a stream of arriving files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumaspark.functions.limits import Limits
from lumaspark.plans import convert

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def watch(spark: SparkSession, folder: str, files_per_trigger: int = 100, limits: Limits = Limits()) -> DataFrame:
    """``(file_id, length, content)`` of files as they arrive; those over the size cap have a null content, and later steps give them
    ``LIMIT_INPUT_BYTES``."""
    found = spark.readStream.schema(SCHEMA).format("binaryFile").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    cap = limits.max_file_size
    content = F.col("content") if cap is None else F.when(F.col("length") <= cap, F.col("content"))
    return found.select(F.col("path").alias("file_id"), "length", content.alias("content"))


def convert_stream(files: DataFrame, sink: str, checkpoint: str, options: dict | None = None, once: bool = False) -> StreamingQuery:
    """Convert arriving files into a Parquet table; the checkpoint makes each file count exactly once."""
    writer = convert.convert(files, options).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
