"""Skip-if-done for document jobs as an incremental file stream.

New documents are found by the stream's own log instead of by looking for output
files; each run processes what arrived since the last one and stops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from firmlens.operators.documents import fixed_chunks
from firmlens.session import shared_dir


def process_new(
    spark: SparkSession,
    source: str,
    schema: str,
    transform: Callable[[DataFrame], DataFrame],
    target: str,
    name: str,
    max_files: int = 1000,
) -> StreamingQuery:
    """Run a row-wise ``transform`` over the parquet files of ``source`` not seen before and append to ``target``.

    The log of seen files lives in the shared folder under ``name``; a run that
    lost executors goes on from it without writing a file twice.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    query = (
        transform(rows)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{shared_dir(spark).rstrip('/')}/streams/{name}")
        .trigger(availableNow=True)
        .start(target)
    )
    query.awaitTermination()
    return query


def chunk_new_documents(spark: SparkSession, source: str, target: str, name: str = "chunks") -> StreamingQuery:
    """Fixed chunks of the documents that have none yet."""
    return process_new(spark, source, "doc_id long, text string", fixed_chunks, target, name)
