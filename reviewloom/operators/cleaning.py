"""Repeated and contradictory reviews.

Groups of equal bodies are found by digest, and each group is reduced in the
partial aggregation. A body that fills a third of the table is one row per
task at the shuffle. Texts stay where they are read: only digests, labels and
the order column are aggregated, and the reviews are joined to the repeated
bodies alone.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.labels import normalize_reviews, star_sentiment
from reviewloom.functions.text import is_blank, text_digest
from reviewloom.operators.audit import row_digest
from reviewloom.schema import INVALID, LABELS

# One bit per label, so the labels of a group combine with bit_or.
_BITS = {label: 1 << i for i, label in enumerate(LABELS + (INVALID,))}


def _label_bit(sentiment):
    bit = F.when(F.col(sentiment) == LABELS[0], _BITS[LABELS[0]])
    for label in (LABELS + (INVALID,))[1:]:
        bit = bit.when(F.col(sentiment) == label, _BITS[label])
    return bit


def prepare_reviews(reviews: DataFrame) -> DataFrame:
    """Label from the stars, NULL titles filled, texts stripped."""
    return normalize_reviews(reviews).withColumn("sentiment", star_sentiment("stars"))


def duplicate_groups(reviews: DataFrame, body="review_body", product="product_id", sentiment="sentiment") -> DataFrame:
    """Bodies that occur more than once, with their duplicate classes.

    ``is_a``: one label; ``is_b``: several labels; ``is_c``: several products,
    whatever the labels. The text is named by its SHA-256.
    """
    per_product = reviews.groupBy(text_digest(body).alias("_body"), product).agg(
        F.count(F.lit(1)).alias("n"), F.bit_or(_label_bit(sentiment)).alias("labels")
    )
    groups = per_product.groupBy("_body").agg(
        F.sum("n").alias("n_rows"),
        F.bit_count(F.bit_or("labels")).cast("long").alias("n_sentiments"),
        F.count(F.lit(1)).alias("n_products"),
    )
    return groups.filter("n_rows > 1").select(
        F.lower(F.hex("_body")).alias("body_sha256"),
        "n_rows",
        "n_sentiments",
        "n_products",
        (F.col("n_sentiments") == 1).alias("is_a"),
        (F.col("n_sentiments") > 1).alias("is_b"),
        (F.col("n_products") > 1).alias("is_c"),
    )


def duplicate_summary(reviews: DataFrame, **columns) -> DataFrame:
    """Rows and texts of the duplicate classes A, B and C, one row each."""
    groups = duplicate_groups(reviews, **columns)
    kinds = {"A": "is_a", "B": "is_b", "C": "is_c"}
    sums = []
    for kind, flag in kinds.items():
        sums.append(F.coalesce(F.sum(F.when(F.col(flag), F.col("n_rows"))), F.lit(0)).alias(f"rows_{kind}"))
        sums.append(F.count_if(F.col(flag)).alias(f"texts_{kind}"))
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), F.col(f"rows_{k}").alias("n_rows"), F.col(f"texts_{k}").alias("n_texts"))
            for k in kinds
        ]
    )
    return groups.agg(*sums).select(F.inline(rows))


def conflicting_bodies(reviews: DataFrame, body="review_body", sentiment="sentiment") -> DataFrame:
    """Digests of the bodies that carry more than one label."""
    return (
        reviews.groupBy(text_digest(body).alias("_body"))
        .agg(F.bit_or(_label_bit(sentiment)).alias("labels"))
        .filter(F.bit_count("labels") > 1)
        .select("_body")
    )


def drop_conflicting(reviews: DataFrame, body="review_body", sentiment="sentiment", conflicts=None) -> DataFrame:
    """Remove all rows of bodies with several labels.

    Pass ``conflicts`` as a staged table and Spark knows its size: small ones
    are broadcast and the reviews are not shuffled at all. Otherwise the join
    runs on the digest, and adaptive execution splits a hot body.
    """
    conflicts = conflicting_bodies(reviews, body, sentiment) if conflicts is None else conflicts
    return reviews.withColumn("_body", text_digest(body)).join(conflicts, "_body", "left_anti").drop("_body")


def dedup_keep_first(reviews: DataFrame, key="review_body", order=("review_id",)) -> DataFrame:
    """The first row of each key, by an explicit order.

    Rows that tie on ``order`` are told apart by the digest of all their
    columns; of rows that are equal in all of them one stays.
    """
    return _keep_first(reviews, _first_places(reviews, key, order), key, order).drop("_agree")


def _place(reviews, order):
    return F.struct(*order, row_digest(reviews.columns).alias("_digest"))


def _first_places(reviews, key, order, *more):
    """One narrow row per key that repeats: the place of its first row, and whether that row itself repeats."""
    places = reviews.select(text_digest(key).alias("_key"), _place(reviews, order).alias("_place"), *more)
    groups = places.groupBy("_key").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_place").alias("_first"),
        F.bit_or("_label").alias("_labels") if more else F.lit(1).alias("_labels"),
        F.count_distinct("_place").alias("_places"),
    )
    return groups.filter("_n > 1").select(
        "_key", "_first", (F.bit_count("_labels") == 1).alias("_agree"), (F.col("_n") > F.col("_places")).alias("_copies")
    )


def _keep_first(reviews, repeated, key, order):
    """The reviews without repeats. Spark broadcasts ``repeated`` where it is small; else a hot key is split."""
    own = reviews.columns
    joined = (
        reviews.withColumn("_place", _place(reviews, order))
        .withColumn("_key", text_digest(key))
        .join(repeated, "_key", "left")
        .filter(F.col("_first").isNull() | (F.col("_first") == F.col("_place")))
    )
    kept = joined.select(*own, F.coalesce("_agree", F.lit(True)).alias("_agree"), "_key", "_copies")
    single = kept.filter("_copies IS NULL OR NOT _copies")
    equal = kept.filter("_copies").dropDuplicates(["_key"])
    return single.unionByName(equal).drop("_key", "_copies")


def drop_empty_body(reviews: DataFrame, body="review_body") -> DataFrame:
    """Without the rows whose body holds nothing but whitespace."""
    return reviews.filter(~is_blank(F.coalesce(F.col(body), F.lit(""))))


def repeated_bodies(prepared: DataFrame, order="review_id") -> DataFrame:
    """One narrow row per repeated body: its first row and if its labels agree.

    Only digest, label and order column are read and shuffled.
    """
    return (
        prepared.groupBy(text_digest("review_body").alias("_body"))
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.bit_or(_label_bit("sentiment")).alias("_labels"),
            F.min(order).alias("_first"),
        )
        .filter("_n > 1")
        .select("_body", "_first", (F.bit_count("_labels") == 1).alias("_agree"))
    )


def clean_reviews(reviews: DataFrame, order="review_id", drop_empty=True, repeated=None) -> DataFrame:
    """Label, normalise, drop contradictory bodies, keep the first of each other.

    The reviews are joined to the few repeated bodies: where these are small
    Spark broadcasts them, and the reviews are not shuffled. ``repeated`` may
    be a staged ``repeated_bodies`` table, which needs no digests of whole rows
    but an ``order`` without ties; without it, ties and equal rows are told
    apart.
    """
    prepared = prepare_reviews(reviews)
    if drop_empty:
        prepared = drop_empty_body(prepared)
    if repeated is None:
        places = _first_places(prepared, "review_body", (order,), _label_bit("sentiment").alias("_label"))
        return _keep_first(prepared, places, "review_body", (order,)).filter("_agree").drop("_agree")
    keep = F.col("_first").isNull() | (F.col("_agree") & (F.col("_first") == F.col(order)))
    return (
        prepared.withColumn("_body", text_digest("review_body"))
        .join(repeated, "_body", "left")
        .filter(keep)
        .drop("_body", "_first", "_agree")
    )


def cleaning_report(reviews: DataFrame, drop_empty=True) -> DataFrame:
    """Rows before, dropped for each reason, and after, by class.

    Long form (metric, label, n, percent), from digests and labels alone.
    """
    prepared = prepare_reviews(reviews.select("review_body", "review_title", "stars"))
    kept = drop_empty_body(prepared) if drop_empty else prepared
    groups = kept.groupBy(text_digest("review_body").alias("_body")).agg(
        F.count(F.lit(1)).alias("n"), F.bit_or(_label_bit("sentiment")).alias("labels")
    )
    agree = F.bit_count("labels") == 1
    row = groups.agg(
        F.sum("n").alias("kept"),
        F.sum(F.when(~agree, F.col("n"))).alias("conflicting"),
        F.sum(F.when(agree, F.col("n") - 1)).alias("repeated"),
        F.count_if(agree).alias("final"),
        F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("in_groups"),
        F.count_if(F.col("n") > 1).alias("groups"),
        *[F.count_if(F.col("labels") == bit).alias(f"final_{label}") for label, bit in _BITS.items()],
    )
    raw = F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.col("review_title").isNull()).alias("untitled"))
    row = row.withColumn("_raw", reviews.agg(raw.alias("r")).scalar()).withColumns(
        {"initial": F.col("_raw.n"), "untitled": F.col("_raw.untitled")}
    )
    zero = F.lit(0)

    def metric(name, value, label=None, percent=None):
        return F.struct(
            F.lit(name).alias("metric"),
            F.lit(label).cast("string").alias("label"),
            F.coalesce(value, zero).cast("long").alias("n"),
            (F.lit(None).cast("double") if percent is None else percent).alias("percent"),
        )

    c = F.col
    metrics = [
        metric("initial_rows", c("initial")),
        metric("filled_titles", c("untitled")),
        metric("rows_in_duplicate_groups", c("in_groups")),
        metric("duplicate_texts", c("groups")),
        metric("dropped_empty_body", c("initial") - F.coalesce(c("kept"), zero)),
        metric("dropped_conflicting", c("conflicting")),
        metric("dropped_repeated", c("repeated")),
        metric("dropped_total", c("initial") - F.coalesce(c("final"), zero)),
        metric("final_rows", c("final")),
    ]
    for label in _BITS:
        n = c(f"final_{label}")
        metrics.append(metric("final_class", n, label, F.when(c("final") > 0, n * 100.0 / c("final"))))
    return row.select(F.inline(F.array(*metrics)))
