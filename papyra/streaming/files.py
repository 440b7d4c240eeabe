"""Streaming extraction: new files through the same stateless plan as a batch, to a sink by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from papyra.session import new_shared_path
from papyra.sources.files import extract_files, stream_files


def extract_stream(spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None], transform: Callable[[DataFrame], DataFrame] = lambda d: d, once: bool = False) -> StreamingQuery:
    """Extract new files of a folder and give each micro-batch to `sink`; `transform` is any stateless plan of this package.

    The query's progress lies in the shared folder; `once` ends it when all files there are done.
    """
    out = transform(extract_files(stream_files(spark, folder)))
    writer = out.writeStream.foreachBatch(sink).option("checkpointLocation", new_shared_path(spark, "stream"))
    return (writer.trigger(availableNow=True) if once else writer).start()
