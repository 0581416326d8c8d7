"""Counts and quantiles that grow by a day: one sketch for each part of a table, merged on reading.

A part is whatever arrives at once, such as a day. Its sketches are a few
kilobytes for each measure, whatever its size. A new part costs one pass over
that part; the figures of all parts together are a merge of sketches.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.text import word_count

#: KLL: items of a level. The rank of a quantile is off by 0.5 percent at most, in 99 of 100 cases.
QUANTILE_K = 600
QUANTILE_ERROR = 0.005
#: HLL: 2**12 registers; the standard error is 1.04 / 2**6.
DISTINCT_LG_K = 12
DISTINCT_ERROR = 1.04 / 2**6


def length_sketches(df: DataFrame, part: str, columns=("review_body", "review_title"), k=QUANTILE_K) -> DataFrame:
    """One row for each part and measure (characters, words): n, exact sums, extremes and a KLL sketch.

    A NULL text counts as empty. A row without a part is in the part NULL.
    """
    measures = []
    for column in columns:
        text = F.coalesce(F.col(column), F.lit(""))
        for unit, size in (("chars", F.length(text).cast("long")), ("words", word_count(text))):
            measures.append(F.struct(F.lit(f"{column}_{unit}").alias("measure"), size.alias("value")))
    value = F.col("value")
    exact = "decimal(38,0)"
    return (
        df.select(F.col(part).alias("part"), F.inline(F.array(*measures)))
        .groupBy("part", "measure")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(value).cast(exact).alias("total"),
            F.sum((value * value).cast("decimal(28,0)")).cast(exact).alias("squares"),
            F.min(value).alias("least"),
            F.max(value).alias("most"),
            F.kll_sketch_agg_bigint(value, F.lit(k)).alias("sketch"),
        )
    )


def merge_length_stats(sketches: DataFrame, k=QUANTILE_K) -> DataFrame:
    """Statistics of each measure over all parts: count, mean, sample deviation and extremes exact, quartiles by sketch."""
    n, s1, s2 = F.col("n"), F.col("total"), F.col("squares")
    variance = (n.cast("decimal(18,0)") * s2 - s1 * s1).cast("double") / (n.cast("double") * (n.cast("double") - 1))
    merged = sketches.groupBy("measure").agg(
        F.sum("n").alias("n"),
        F.sum("total").cast("decimal(18,0)").alias("total"),
        F.sum("squares").cast("decimal(19,0)").alias("squares"),
        F.min("least").alias("min"),
        F.max("most").alias("max"),
        F.kll_merge_agg_bigint("sketch", F.lit(k)).alias("sketch"),
    )
    quantiles = [
        F.kll_sketch_get_quantile_bigint("sketch", F.lit(rank)).alias(name)
        for name, rank in (("median", 0.5), ("q25", 0.25), ("q75", 0.75))
    ]
    mean = s1.cast("double") / n.cast("double")
    return merged.select("measure", "n", mean.alias("mean"), F.when(n > 1, F.sqrt(variance)).alias("std"), "min", "max", *quantiles)


def rank_errors(df: DataFrame, stats: DataFrame, columns=("review_body", "review_title")) -> DataFrame:
    """How far the share of values up to each quartile of ``stats`` is off, counted exactly; 0 where ties hold the rank."""
    measures = []
    for column in columns:
        text = F.coalesce(F.col(column), F.lit(""))
        for unit, size in (("chars", F.length(text).cast("long")), ("words", word_count(text))):
            measures.append(F.struct(F.lit(f"{column}_{unit}").alias("measure"), size.alias("value")))
    named = {"median": 0.5, "q25": 0.25, "q75": 0.75}
    joined = df.select(F.inline(F.array(*measures))).join(F.broadcast(stats.select("measure", *named)), "measure")
    counts = joined.groupBy("measure").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col("value") < F.col(q)).alias(f"_below_{q}") for q in named],
        *[F.count_if(F.col("value") <= F.col(q)).alias(f"_upto_{q}") for q in named],
    )

    def error(q, rank):
        return F.greatest(F.lit(0.0), F.col(f"_below_{q}") / F.col("_n") - rank, F.lit(rank) - F.col(f"_upto_{q}") / F.col("_n"))

    return counts.select("measure", *[error(q, rank).alias(f"{q}_error") for q, rank in named.items()])


def distinct_sketches(df: DataFrame, part: str, columns=("review_id", "product_id", "reviewer_id"), lg_k=DISTINCT_LG_K) -> DataFrame:
    """One row for each part, with an HLL sketch of each column as ``sketch_<column>``; NULL is no value."""
    sketches = [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(lg_k)).alias(f"sketch_{c}") for c in columns]
    return df.groupBy(F.col(part).alias("part")).agg(*sketches)


def merge_distinct_counts(sketches: DataFrame) -> DataFrame:
    """Distinct values of each column over all parts, as ``distinct_<column>``."""
    columns = [c.removeprefix("sketch_") for c in sketches.columns if c.startswith("sketch_")]
    return sketches.agg(*[F.hll_sketch_estimate(F.hll_union_agg(f"sketch_{c}")).alias(f"distinct_{c}") for c in columns])
