"""Scoring with a saved pipeline, as a batch job and as a streaming job.

``spark-submit reviewloom/plans/scoring_job.py batch MODEL REVIEWS OUTPUT [TEXT_COLUMN]``
``spark-submit reviewloom/plans/scoring_job.py stream MODEL FOLDER OUTPUT CHECKPOINT [TEXT_COLUMN]``
"""

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from reviewloom.operators.scoring import score_batch, score_sample, score_summary
from reviewloom.session import stage
from reviewloom.sources.reviews import detect_text_column, read_reviews, validate_input
from reviewloom.sources.tables import load_pipeline, write_table
from reviewloom.streaming.scoring import score_stream

SAMPLE_ROWS = 50


def score_table(
    reviews: DataFrame, model_path: str, output: str, text_column=None, order=None, file_format="parquet"
) -> dict[str, DataFrame]:
    """Score a whole table with the saved pipeline, ungated, and write it.

    Returns the tables written: ``scored`` (all input columns, label,
    confidence, preprocessed text), ``summary`` (rows in all and per class) and
    ``sample`` (the first rows by ``order``, the text column unless named). An
    empty table or one without a text column is an error. The summary and the
    sample read the written table, so the reviews are scored once.
    """
    spark = reviews.sparkSession
    column = detect_text_column(validate_input(reviews), text_column)
    model, settings = load_pipeline(spark, model_path)
    answers = score_batch(reviews, model, column, settings["text_mode"], with_processed_text=True)
    write_table(answers, f"{output}/scored")
    scored = spark.read.parquet(f"{output}/scored")
    if file_format == "csv":
        write_table(scored, f"{output}/scored_csv", "csv")
    tables = {
        "summary": score_summary(scored, column),
        "sample": score_sample(scored, column, order or column, SAMPLE_ROWS),
    }
    for name, df in tables.items():
        write_table(df, f"{output}/{name}")
    return {"scored": scored, **{name: spark.read.parquet(f"{output}/{name}") for name in tables}}


def score_upload(spark: SparkSession, path: str, model_path: str, output: str, text_column=None) -> dict[str, DataFrame]:
    """The batch job on a file of unknown columns.

    A CSV file is one task, so it is landed as Parquet first and scored in
    parallel from there.
    """
    reviews = read_reviews(spark, path, schema=None)
    if str(path).endswith((".csv", ".csv.gz")):
        reviews = stage(reviews, "upload").repartition(spark.sparkContext.defaultParallelism)
    return score_table(reviews, model_path, output, text_column)


def score_folder(
    spark: SparkSession,
    folder: str,
    schema,
    model_path: str,
    output: str,
    checkpoint: str,
    text_column=None,
    files_per_trigger=None,
    file_format="parquet",
    **trigger,
) -> StreamingQuery:
    """The streaming job: every file that arrives in ``folder``, gated and scored.

    ``files_per_trigger`` bounds a micro-batch. Without a trigger the job
    handles what is there and ends; ``processingTime="1 minute"`` goes on.
    """
    model, settings = load_pipeline(spark, model_path)
    reader = spark.readStream.schema(schema).format(file_format)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return score_stream(reader.load(folder), model, output, checkpoint, text_column, settings["text_mode"], **trigger)


if __name__ == "__main__":
    session = SparkSession.builder.appName("review scoring").getOrCreate()
    kind, model_folder, source, target, *more = sys.argv[1:]
    if kind == "batch":
        score_upload(session, source, model_folder, target, *more)
    else:
        columns = session.read.parquet(source).schema
        score_folder(
            session, source, columns, model_folder, target, more[0], *more[1:], processingTime="1 minute"
        ).awaitTermination()
