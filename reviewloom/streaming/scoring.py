"""Scoring reviews as they arrive."""

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from reviewloom.operators.scoring import score_gated


def score_stream(
    reviews: DataFrame,
    model: PipelineModel,
    path: str,
    checkpoint: str,
    text_column=None,
    text_mode="raw",
    file_format="parquet",
    **trigger,
) -> StreamingQuery:
    """Score a stream with the same row logic and pipeline as the batch job.

    The job keeps no state: each micro-batch is one map over its rows, and the
    checkpoint makes the file sink write every review exactly once. By default
    it handles all input present and stops.
    """
    return (
        score_gated(reviews, model, text_column, text_mode)
        .writeStream.format(file_format)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )
