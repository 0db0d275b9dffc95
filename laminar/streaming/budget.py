"""Streams with a time budget: what is not done in time is left to the next run."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "run string, batches long, seconds double, complete boolean"


def run_within(stream: DataFrame, figures: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, seconds: float, clock: Callable[[], float] = time.monotonic) -> bool:
    """Append ``figures`` of each micro-batch of ``stream`` to ``out/data`` until all input is read or ``seconds`` are over.

    A batch that would begin past the deadline is refused, which ends the run; by then the one before it is committed in
    ``checkpoint``, and the next run begins with the refused one. The first batch of a run is never refused, so every run gets on.
    A batch interrupted half-way is repeated and overwrites its own folder. Each run adds a row to ``out/manifest``: its number of
    batches, its seconds, and ``complete``, true only where the input was read to its end. Returns ``complete``.
    """
    spark = stream.sparkSession
    begun, refused, done = clock(), [], []

    def put(batch: DataFrame, number: int) -> None:
        if done and clock() - begun >= seconds:
            refused.append(number)
            raise TimeoutError("time budget")
        figures(batch).write.mode("overwrite").parquet(f"{out}/data/batch={number}")
        done.append(number)

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not refused:
            raise
    complete = not refused
    row = [(uuid.uuid4().hex, len(done), float(clock() - begun), complete)]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").parquet(f"{out}/manifest")
    return complete


def results(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """The figures of all batches of all runs."""
    return spark.read.schema(f"{schema}, batch long").parquet(f"{out}/data").drop("batch")


def is_complete(spark: SparkSession, out: str) -> bool:
    """Whether a run has reached the end of the input."""
    return bool(spark.read.schema(MANIFEST).parquet(f"{out}/manifest").agg(F.bool_or("complete")).first()[0])
