"""Counts kept up to date over a stream of files: an extension, as k-mers and chunks are counted in batch elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def chunk_counts(nodes: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """A memory table ``name`` of (chunk, n) over a stream of nodes."""
    n = nodes.groupBy("chunk").agg(F.count("*").alias("n"))
    return n.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
