"""Summaries of a stream of scored reviews by windows of event time.

Counts are state of the stream; a watermark bounds how long a window stays in
it. Each micro-batch writes the windows that it has changed to a folder of its
own, which a batch that runs again replaces, so that a failure counts nothing
twice. The newest row of each window is the answer, before a window is closed
as well as after.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewloom.schema import NEGATIVE, NEUTRAL, POSITIVE

LABEL = "predicted_sentiment"


def _start(changes: DataFrame, path: str, checkpoint: str, mode: str, **trigger) -> StreamingQuery:
    def write(batch: DataFrame, number: int):
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:09d}")

    return (
        changes.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _windowed(scored, time, window, delay):
    return scored.withWatermark(time, delay).withColumn("window", F.window(time, window))


def _bounds(df, *columns):
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *columns)


def stream_summary(
    scored: DataFrame, path: str, checkpoint: str, time: str, window="1 hour", delay="1 hour", label=LABEL, **trigger
) -> StreamingQuery:
    """Reviews in all and of each class per window. Rows later than ``delay`` are not counted: see ``late_rows``."""
    counts = _windowed(scored, time, window, delay).groupBy("window").agg(
        F.count(F.lit(1)).alias("total_reviews"),
        *[F.count_if(F.col(label) == c).alias(f"{c.lower()}_count") for c in (POSITIVE, NEGATIVE, NEUTRAL)],
    )
    columns = [c for c in counts.columns if c != "window"]
    return _start(_bounds(counts, *columns), path, checkpoint, "update", **trigger)


def stream_words(
    scored: DataFrame, path: str, checkpoint: str, time: str, window="1 hour", delay="1 hour", text="processed_text", label=LABEL, **trigger
) -> StreamingQuery:
    """Words of each class per window, counted as state; ``window_top_words`` ranks them."""
    words = F.explode(F.regexp_extract_all(text, F.lit(r"(?U)[^\s\x1C-\x1F]+"), F.lit(0)))
    rows = scored.select(time, F.col(label).alias("label"), words.alias("word"))
    counts = _windowed(rows, time, window, delay).groupBy("window", "label", "word").agg(F.count(F.lit(1)).alias("n"))
    return _start(_bounds(counts, "label", "word", "n"), path, checkpoint, "update", **trigger)


def stream_arrivals(scored: DataFrame, path: str, checkpoint: str, time: str, window="1 hour", **trigger) -> StreamingQuery:
    """Rows per window and micro-batch as they arrive, late or not; no state."""

    def count(batch: DataFrame, number: int):
        counts = batch.groupBy(F.window(time, window).alias("window")).agg(F.count(F.lit(1)).alias("arrived"))
        _bounds(counts, "arrived").write.mode("overwrite").parquet(f"{path}/batch={number:09d}")

    return (
        scored.writeStream.foreachBatch(count)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _newest(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The last row that was written for each key."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return newest.select(*keys, "_v.*")


def window_summaries(spark: SparkSession, path: str) -> DataFrame:
    """What ``stream_summary`` knows of each window by now."""
    return _newest(spark, path, "window_start", "window_end")


def window_top_words(spark: SparkSession, path: str, n=10) -> DataFrame:
    """The most frequent words of each class and window, ties by word, from what ``stream_words`` has written."""
    counts = _newest(spark, path, "window_start", "window_end", "label", "word").filter("label IS NOT NULL")
    ranked = Window.partitionBy("window_start", "label").orderBy(F.desc("n"), "word")
    return counts.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= n)


def late_rows(spark: SparkSession, arrivals: str, summaries: str) -> DataFrame:
    """Rows of each window that came too late to be counted: those that arrived less those in its summary."""
    bounds = ["window_start", "window_end"]
    arrived = spark.read.parquet(arrivals).groupBy(*bounds).agg(F.sum("arrived").alias("arrived"))
    counted = window_summaries(spark, summaries).select(*bounds, F.col("total_reviews").alias("counted"))
    joined = arrived.join(counted, bounds, "left")
    return joined.select(*bounds, "arrived", (F.col("arrived") - F.coalesce("counted", F.lit(0))).alias("late"))
