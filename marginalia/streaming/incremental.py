"""Incremental runs: the per-document operators are stateless, so a stream of documents runs them batch by batch.

An extension: each micro-batch is distilled and appended under its content fingerprint; a document that was seen before within the
watermark is not distilled again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.operators import statements
from marginalia.sources.documents import fingerprint


def fresh(stream: DataFrame, at: str = "at", within: str = "7 days", text: str = "text") -> DataFrame:
    """Documents whose fingerprint did not occur within the watermark before."""
    return stream.withColumn("fingerprint", fingerprint(F.col(text))).withWatermark(at, within).dropDuplicatesWithinWatermark(["fingerprint"])


def run(stream: DataFrame, sink: str, checkpoint: str, process: Callable[[DataFrame], DataFrame] = statements.counts) -> StreamingQuery:
    """Writes `process` of each micro-batch to a Parquet folder; a batch that is retried replaces its own partition."""

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
