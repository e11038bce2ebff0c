"""Scoring of a stream of requests: each micro-batch goes through the batch plan, so ranking needs no streaming window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecscore.plans.score import score
from vecscore.sources.ingest import parse_requests


def score_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, vectors: DataFrame, centroids: DataFrame, max_files: int = 64) -> None:
    """Scores the requests (event_id, json) in source's Parquet files into sink, and returns when those that are there are done. A batch that is run again replaces its own rows."""
    stream = spark.readStream.schema("event_id BIGINT, json STRING").option("maxFilesPerTrigger", max_files).parquet(source)

    def each(batch: DataFrame, number: int) -> None:
        score(parse_requests(batch), vectors, centroids).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
