"""Notes as they arrive in a folder: each file once, through any transform of the batch engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cartula.sources.readers import notes


def process(spark: SparkSession, folder: str, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], files_per_batch: int = 1000) -> StreamingQuery:
    """Runs transform over the notes that have not been processed, and writes Parquet to out, a folder a batch.

    A batch that is repeated after a failure writes its own folder anew, so no row is there twice.
    All that transforms do is within a note, so batches need no state.
    """

    def one(batch: DataFrame, number: int) -> None:
        transform(batch.drop("ord")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = notes(spark, folder, streaming=True, files=files_per_batch)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
