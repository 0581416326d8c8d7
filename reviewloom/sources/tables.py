"""Result tables, reports and fitted pipelines out and back in."""

import json

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, file_format="parquet", mode="overwrite", partition_by=()):
    """Write a table; CSV gets a header and keeps outer spaces; empty text reads back as NULL."""
    writer = df.write.mode(mode).partitionBy(*partition_by)
    if file_format == "csv":
        writer.options(
            header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        ).csv(path)
    elif file_format == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported table format: {file_format}")


def write_report(df: DataFrame, path: str):
    """Write a small report as JSON lines.

    A table whose only column is ``report`` already holds JSON documents and
    is written as it is.
    """
    if df.columns == ["report"]:
        df.coalesce(1).write.mode("overwrite").text(path)
    else:
        df.coalesce(1).write.mode("overwrite").json(path)


def save_pipeline(model: PipelineModel, path: str, **settings):
    """Save a fitted pipeline with the settings its scorer needs."""
    model.write().overwrite().save(f"{path}/pipeline")
    spark = SparkSession.active()
    row = [(json.dumps(settings, sort_keys=True),)]
    spark.createDataFrame(row, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def load_pipeline(spark: SparkSession, *paths: str):
    """The first pipeline found among ``paths``, and its settings.

    List the preferred place first. No pipeline in any place is an error.
    """
    for path in paths:
        try:
            settings = spark.read.text(f"{path}/settings").first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        return PipelineModel.load(f"{path}/pipeline"), json.loads(settings.value)
    raise FileNotFoundError(f"no fitted pipeline in {', '.join(paths) or 'an empty list of places'}")
