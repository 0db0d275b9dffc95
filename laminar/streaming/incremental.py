"""Incremental quality control: slabs arrive as files, their figures are appended once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_per_slab(stream: DataFrame, figures: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "slab") -> StreamingQuery:
    """Run ``figures`` over each micro-batch and append its rows to ``out`` (Parquet, a folder per batch).

    A batch that is replayed after a failure overwrites its own folder, so no slab is counted twice. The
    stream stops when everything there has been read.
    """

    def put(batch: DataFrame, number: int) -> None:
        figures(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, size: str, slide: str, late: str, by: list[str]) -> DataFrame:
    """Counts and sums per sliding window and key; rows later than ``late`` are dropped with their window."""
    w = F.window(ts, size, slide)
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def run_to_table(spark: SparkSession, frame: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Drain a streaming frame into Parquet (append mode) and return the table."""
    query = frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(out)
