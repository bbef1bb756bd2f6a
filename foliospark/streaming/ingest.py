"""Pages as a stream: image files as they arrive, and stateless layout of each micro-batch's pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.layout import paragraphs


def image_stream(spark: SparkSession, path: str, pattern: str = "*", per_batch: int = 1000) -> DataFrame:
    """path, modificationTime, length, content of image files, as they arrive in a folder."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    options = {"pathGlobFilter": pattern, "maxFilesPerTrigger": str(per_batch)}
    return spark.readStream.format("binaryFile").schema(schema).options(**options).load(path)


def element_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Elements of pages as JSON lines, as they arrive; all elements of a page must be in one file."""
    return spark.readStream.schema(schema).json(path)


def write_paragraphs(elements: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the paragraphs of each micro-batch's pages to a Parquet table; pages are whole within a batch."""

    def append(batch: DataFrame, number: int) -> None:
        paragraphs(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return elements.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
