"""Review tables in, and the checks on an uploaded table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from reviewloom.schema import REVIEW_SCHEMA
from reviewloom.sources.quoted_csv import RANGE_BYTES, csv_files, read_quoted_csv

# Names of a text column, the first one present is used.
TEXT_COLUMNS = ("reviewText", "review", "review_text", "text", "comment", "feedback", "summary", "body")


def read_reviews(spark: SparkSession, path: str, schema=REVIEW_SCHEMA, file_format=None, range_bytes=RANGE_BYTES) -> DataFrame:
    """A review table from CSV with a header, or from Parquet.

    ``schema=None`` takes the column names from the CSV header and reads every
    column as text, for uploads of unknown shape. Quoted fields may hold line
    ends and doubled quotes; empty fields are NULL. A missing path is an error.
    A plain CSV file is read by ranges of ``range_bytes``; a compressed one, and
    one in a store that only Spark reads, is one task.
    """
    file_format = file_format or ("csv" if str(path).endswith((".csv", ".csv.gz")) else "parquet")
    if file_format == "parquet":
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if file_format != "csv":
        raise ValueError(f"unsupported review format: {file_format}")
    if _plain_files(path):
        return read_quoted_csv(spark, path, schema, range_bytes)
    reader = spark.read.options(header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)
    return (reader.schema(schema) if schema else reader).csv(path)


def _plain_files(path) -> bool:
    """Whether byte ranges of the files can be read; a missing path is left to Spark's reader to report."""
    try:
        _, files = csv_files(path)
    except (ValueError, FileNotFoundError):
        return False
    return bool(sum(size for _, size in files)) and not any(name.endswith((".gz", ".bz2", ".zst", ".lz4", ".snappy")) for name, _ in files)


def detect_text_column(df: DataFrame, text_column: str | None = None) -> str:
    """The column that holds the review text, from the schema alone."""
    if text_column:
        if text_column not in df.columns:
            raise ValueError(f"no column {text_column!r} in {df.columns}")
        return text_column
    for name in TEXT_COLUMNS:
        if name in df.columns:
            return name
    for field in df.schema:
        if isinstance(field.dataType, T.StringType):
            return field.name
    raise ValueError("no text column: the table needs a column with reviews")


def validate_input(df: DataFrame) -> DataFrame:
    """The table itself; an empty one is an error."""
    if df.isEmpty():
        raise ValueError("the table of reviews is empty")
    return df
