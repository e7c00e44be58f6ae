"""Chunking of a stream of documents. Chunking looks at one document at a time, so it needs no state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.chunking import chunk_by_size


def write_chunks(documents: DataFrame, path: str, checkpoint: str, chunker: Callable[[DataFrame], DataFrame] = chunk_by_size) -> StreamingQuery:
    """Appends the chunks of each new document to the table at path; takes what is there and ends."""
    return chunker(documents).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
