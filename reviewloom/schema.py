"""Table schemas and the fixed class order."""

from pyspark.sql import types as T

NEGATIVE, NEUTRAL, POSITIVE, INVALID = "Negative", "Neutral", "Positive", "Invalid"

# Class order of every model and metric: alphabetical, index 0, 1, 2.
LABELS = (NEGATIVE, NEUTRAL, POSITIVE)

STARS = (1, 2, 3, 4, 5)

REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("review_id", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("reviewer_id", T.StringType()),
        T.StructField("stars", T.IntegerType()),
        T.StructField("review_body", T.StringType()),
        T.StructField("review_title", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("product_category", T.StringType()),
    ]
)

LEGACY_REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("reviewText", T.StringType()),
        T.StructField("overall", T.DoubleType()),
        T.StructField("sentiment", T.StringType()),
    ]
)
