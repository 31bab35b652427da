"""Raster files as a stream: new files in a folder become rows of the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gridloom.sources import scan


def stream_files(spark: SparkSession, folder: str, glob: str = "*", files_per_trigger: int = 1000) -> DataFrame:
    """Unbounded (path, content) of the files that come into a folder. The session keeps fewer tasks for listing files: by default each file of a batch is a task, and a result sent to the driver."""
    known = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    spark.conf.set(known, str(min(int(spark.conf.get(known)), spark.sparkContext.defaultParallelism)))
    return spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).schema("path string, modificationTime timestamp, length bigint, content binary").load(folder).select("path", "content")


def stream_table(spark: SparkSession, folder: str, table: str = "pages", glob: str = "*", options: scan.Options = scan.Options()) -> DataFrame:
    """files, pages, tags, chunks or decoded of a stream of files."""
    make = {"files": scan.files, "pages": scan.pages, "tags": scan.tags, "chunks": scan.chunks, "decoded": scan.decode}[table]
    return make(stream_files(spark, folder, glob), options)


def append_table(stream: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write a stream's rows to Parquet, each file's once even if the query is stopped and started again; with ``once`` it ends when all that is there is read."""
    out = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()
