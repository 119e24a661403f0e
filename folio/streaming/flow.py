"""Conversion and splitting of files as they arrive: stateless, append only, no watermark needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.convert import convert_and_split
from folio.plans.splitting import Options
from folio.sources.base import Registry

FILE = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, folder: str, at_once: int = 1000, pattern: str = "*") -> DataFrame:
    """Files of a folder as rows, each once; at_once files a micro-batch bound its size."""
    return spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", at_once).option("pathGlobFilter", pattern).load(folder)


def chunk_stream(files: DataFrame, options: Options, registry: Registry | None = None) -> DataFrame:
    """Chunks of files (streaming or not), with path and the sections that they meet."""
    return convert_and_split(files, options, name="path", registry=registry, keep=["path"])


def write_chunks(chunks: DataFrame, folder: str, checkpoint: str, once: bool = True):
    """Appends chunks as Parquet, exactly once; once: what is there now, then ends. Both folders are shared ones."""
    writer = chunks.withColumn("day", F.current_date()).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
