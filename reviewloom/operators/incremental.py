"""Cleaning of reviews that arrive in batches, with the answer of one cleaning of all.

What is known of each body is a state: its digest, the first row that holds
it, its rows and its labels. The state is a log: each batch appends one narrow
row for each body in it, and reads of the log only the bodies it shares with
the batch. A batch answers with changes: rows that are added to the clean
table, and earlier rows that leave it because their body has got another label
or an earlier row.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.functions.text import text_digest
from reviewloom.operators.cleaning import _label_bit, drop_empty_body, prepare_reviews


def body_states(reviews: DataFrame, order="review_id") -> DataFrame:
    """One row for each body of prepared reviews: digest, first row by ``order``, rows and label bits."""
    return reviews.groupBy(text_digest("review_body").alias("body")).agg(
        F.min(order).alias("first"),
        F.count(F.lit(1)).alias("n"),
        F.bit_or(_label_bit("sentiment")).cast("int").alias("labels"),
    )


def merged(states: DataFrame) -> DataFrame:
    """States of several batches as one row for each body. They may come in any order."""
    return states.groupBy("body").agg(
        F.min("first").alias("first"), F.sum("n").alias("n"), F.bit_or("labels").alias("labels")
    )


def _kept(states):
    """The row of a body that the clean table holds; NULL for none."""
    return F.when(F.bit_count(states("labels")) == 1, states("first"))


class BodyLog:
    """The log of body states under a path, one folder a batch; a batch that failed and runs again replaces its own."""

    def __init__(self, spark: SparkSession, path: str, order="review_id"):
        self.spark, self.path, self.order = spark, path, order

    def _folder(self, batch: int) -> str:
        return f"{self.path}/batch={batch:09d}"

    def _before(self, batch: int, schema):
        # batches after this one may be there when it is run again; they are not its past
        if batch == 0:
            return self.spark.createDataFrame([], schema)
        log = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])).parquet(self.path)
        return log.filter(F.col("batch") < batch).drop("batch")

    def add(self, reviews: DataFrame, batch: int) -> DataFrame:
        """Clean a batch of new reviews, number ``batch`` from 0 on; returns its changes.

        Changes: ``review_id`` (or ``order``) and ``action``, ``add`` or ``retract``. Only
        the digests of the log and its rows for the bodies of this batch are read;
        Spark broadcasts the batch's digests where they are few. ``order`` has no ties.
        """
        prepared = drop_empty_body(prepare_reviews(reviews))
        body_states(prepared, self.order).write.mode("overwrite").parquet(self._folder(batch))
        new = self.spark.read.parquet(self._folder(batch))
        old = merged(self._before(batch, new.schema).join(new.select("body"), "body", "left_semi"))
        both = new.alias("new").join(old.alias("old"), "body", "left").select(
            _kept(lambda c: F.col(f"old.{c}")).alias("before"),
            F.least(F.col("old.first"), F.col("new.first")).alias("first"),
            F.col("new.labels").bitwiseOR(F.coalesce("old.labels", F.lit(0))).alias("labels"),
        )
        after = both.withColumn("after", _kept(F.col)).filter(~F.col("before").eqNullSafe(F.col("after")))
        rows = F.array(
            F.struct(F.col("before").alias(self.order), F.lit("retract").alias("action")),
            F.struct(F.col("after").alias(self.order), F.lit("add").alias("action")),
        )
        return after.select(F.inline(rows)).filter(F.col(self.order).isNotNull())

    def states(self) -> DataFrame:
        return merged(self.spark.read.parquet(self.path).drop("batch"))

    def kept(self) -> DataFrame:
        """The order column of all rows of the clean table."""
        return self.states().select(_kept(F.col).alias(self.order)).filter(F.col(self.order).isNotNull())

    def compact(self, path: str) -> "BodyLog":
        """The log as one batch (number 0) under a new path; the next batch there is number 1."""
        self.states().write.mode("overwrite").parquet(f"{path}/batch={0:09d}")
        return BodyLog(self.spark, path, self.order)


def apply_changes(kept: DataFrame, reviews: DataFrame, changes: DataFrame, order="review_id") -> DataFrame:
    """The clean table after a batch: without what it retracts, and with what it adds from ``reviews`` (all so far)."""
    retracted = changes.filter("action = 'retract'").select(order)
    added = changes.filter("action = 'add'").select(order)
    fresh = prepare_reviews(reviews).join(added, order, "left_semi")
    return kept.join(retracted, order, "left_anti").unionByName(fresh)
