"""A review table over the sample tables, which hold no reviews.

``documents`` gives id, text, language and source; stars, product, reviewer
and category follow from id and source. ``labels`` gives the training labels.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions.labels import star_sentiment
from reviewloom.schema import NEGATIVE, NEUTRAL, POSITIVE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample_reviews(spark: SparkSession, sf_dir: str, products=97) -> DataFrame:
    """Reviews with ``products`` products per source; 7 gives products of several reviews."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        d.alias("review_id"),
        F.concat("source", F.lit(":"), (d % products).cast("string")).alias("product_id"),
        F.concat(F.lit("u"), (d % 53).cast("string")).alias("reviewer_id"),
        (1 + d % 5).cast("int").alias("stars"),
        F.col("text").alias("review_body"),
        F.when(d % 61 != 0, F.split_part("text", F.lit("."), F.lit(1))).alias("review_title"),
        F.col("lang").alias("language"),
        F.concat("lang", F.lit("-"), (d % 3).cast("string")).alias("product_category"),
    )


def labelled_reviews(spark: SparkSession, sf_dir: str, products=7) -> DataFrame:
    """The reviews that ``labels`` covers, with its judgement as ``sentiment``."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("review_id"),
        F.when(F.col("toxic") == 1, NEGATIVE).when(F.col("quality") == 1, POSITIVE).otherwise(NEUTRAL).alias("sentiment"),
    )
    return sample_reviews(spark, sf_dir, products).join(labels, "review_id")


def scored_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reviews with a label and a reproducible prediction, for the metrics."""
    return (
        sample_reviews(spark, sf_dir)
        .withColumn("sentiment", star_sentiment("stars"))
        .withColumn("predicted_sentiment", star_sentiment(1 + (F.col("review_id") * 7 + F.floor(F.col("review_id") / 5)) % 5))
        .withColumn("confidence", F.round((F.col("review_id") % 1000) / 10.0, 2))
    )
