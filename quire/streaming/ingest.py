"""Continuous ingestion: each arriving document is chunked by itself, so there is no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.operators.chunker import Options, chunk_documents
from quire.sources.files import detect_kind, documents


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.sql import functions as F

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(path)
    return files.filter("length > 0").select("path", "content", detect_kind(F.col("content"), F.col("path")).alias("kind"), F.sha2("content", 256).alias("document_id"))


def stream_chunks(spark: SparkSession, source: str, target: str, checkpoint: str, options: Options = Options()) -> StreamingQuery:  # noqa: B008
    """Chunks of every file that arrives below ``source``, as partitions ``batch`` of the Parquet table ``target``.

    A batch that is tried again replaces its own partition, so its rows are never doubled.
    """
    docs = documents(stream_files(spark, source)).filter("markdown IS NOT NULL")

    def write(batch: DataFrame, number: int) -> None:
        chunk_documents(batch, "document_id", "markdown", options).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
