"""Scoring reviews with a fitted pipeline."""

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.functions.gate import domain_gate
from reviewloom.functions.labels import label_name
from reviewloom.functions.text import clean_text, is_blank, nlp_steps, preprocess
from reviewloom.operators import features as X
from reviewloom.operators.models import PREDICTION, PROBABILITY, RAW
from reviewloom.schema import LABELS, NEGATIVE, NEUTRAL, POSITIVE
from reviewloom.sources.reviews import detect_text_column

_INTERNAL = (X.TEXT, X.WORDS, X.TERMS, X.TF, X.WEIGHTED, X.FEATURES, RAW, PROBABILITY, PREDICTION)


def score_batch(
    df: DataFrame,
    model: PipelineModel,
    text_column=None,
    text_mode="raw",
    with_processed_text=False,
    with_probabilities=False,
) -> DataFrame:
    """All input columns, the predicted label and its probability in percent.

    ``text_mode`` must be the one the pipeline was trained with, unless the
    difference between training and scoring text is wanted. No gate.
    """
    column = detect_text_column(df, text_column)
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    processed = text_mode == "processed"
    scored = model.transform(df.withColumn(X.TEXT, preprocess(text) if processed else text))
    probability = vector_to_array(PROBABILITY)
    scored = scored.withColumns(
        {
            "predicted_sentiment": label_name(PREDICTION),
            "confidence": F.round(F.array_max(probability) * 100, 2),
        }
    )
    if with_processed_text:
        scored = scored.withColumn("processed_text", F.col(X.TEXT) if processed else preprocess(text))
    if with_probabilities:
        scored = scored.withColumns({f"prob_{label}": probability[i] for i, label in enumerate(LABELS)})
    return scored.drop(*_INTERNAL)


def score_gated(df: DataFrame, model: PipelineModel, text_column=None, text_mode="raw") -> DataFrame:
    """Gate first, then label: the full answer for each review, row by row.

    Rejected reviews have no label and zero probabilities; blank ones are
    Neutral with equal probabilities. No row is dropped.
    """
    column = detect_text_column(df, text_column)
    steps = nlp_steps(df.withColumn("_text", F.coalesce(F.col(column).cast("string"), F.lit(""))), "_text", "_steps")
    cleaned, processed = F.col("_steps.cleaned_text"), F.col("_steps.processed_text")
    usable = F.when(processed != "", processed).otherwise(cleaned)
    scored = model.transform(
        steps.withColumn("_gate", domain_gate("_text")).withColumn(
            X.TEXT, usable if text_mode == "processed" else F.col("_text")
        )
    ).withColumn("_p", vector_to_array(PROBABILITY))

    blank, accepted = is_blank("_text"), F.col("_gate.is_product_feedback")

    def percents(values):
        pairs = []
        for label in (POSITIVE, NEGATIVE, NEUTRAL):
            pairs += [F.lit(label), values(label)]
        return F.create_map(*pairs)

    thirds = {POSITIVE: 33.33, NEGATIVE: 33.33, NEUTRAL: 33.34}
    features = F.size(X.sparse_parts(X.FEATURES)["indices"]).cast("long")
    vocabulary_size = F.lit(len(X.feature_terms(model))).cast("long")
    answer = scored.withColumns(
        {
            "is_valid_domain": accepted,
            "domain_status": F.col("_gate.domain_status"),
            "domain_message": F.col("_gate.message"),
            "sentiment": F.when(blank, NEUTRAL).when(accepted, label_name(PREDICTION)),
            "confidence": F.when(accepted, F.round(F.array_max("_p") * 100, 2)).otherwise(0.0),
            "predicted_class_probability": F.when(accepted, F.round(F.array_max("_p") * 100, 2)).otherwise(0.0),
            "probabilities": F.when(blank, percents(lambda c: F.lit(thirds[c])))
            .when(accepted, percents(lambda c: F.round(F.col("_p")[LABELS.index(c)] * 100, 2)))
            .otherwise(percents(lambda c: F.lit(0.0))),
            "cleaned_text": F.when(accepted, usable).otherwise(cleaned),
            "nlp_steps": F.when(
                ~blank,
                F.col("_steps")
                .withField("num_nonzero_features", features)
                .withField("vocabulary_size", vocabulary_size)
                .withField("model_used", F.lit(f"TF-IDF + {type(model.stages[-1]).__name__.removesuffix('Model')}")),
            ),
        }
    )
    return answer.drop("_text", "_steps", "_gate", "_p", *_INTERNAL)


def gate_reviews(df: DataFrame, text_column=None) -> DataFrame:
    """The gate alone: input columns, status, message and cleaned text."""
    column = detect_text_column(df, text_column)
    return (
        df.withColumn("_gate", domain_gate(column))
        .withColumns(
            {
                "is_valid_domain": F.col("_gate.is_product_feedback"),
                "domain_status": F.col("_gate.domain_status"),
                "domain_message": F.col("_gate.message"),
                "cleaned_text": clean_text(column),
            }
        )
        .drop("_gate")
    )


def score_summary(scored: DataFrame, text_column: str | None = None, label="predicted_sentiment") -> DataFrame:
    """Reviews in all and per class, 0 where a class is absent."""
    return scored.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        *[F.count_if(F.col(label) == c).alias(f"{c.lower()}_count") for c in (POSITIVE, NEGATIVE, NEUTRAL)],
        F.lit(text_column).cast("string").alias("detected_text_column"),
    )


def score_sample(scored: DataFrame, text_column: str, order: str, n=50) -> DataFrame:
    """Text, label and confidence of the first ``n`` rows by an explicit order."""
    return scored.orderBy(order).limit(n).select(text_column, "predicted_sentiment", "confidence")


def _word_counts(scored, text, label):
    words = F.explode(F.regexp_extract_all(text, F.lit(r"(?U)[^\s\x1C-\x1F]+"), F.lit(0)))
    return scored.select(F.col(label).alias("label"), words.alias("word")).groupBy("label", "word").agg(
        F.count(F.lit(1)).alias("n")
    )


def _label_column(scored):
    return "sentiment" if "sentiment" in scored.columns else "predicted_sentiment"


def top_words(scored: DataFrame, label: str, text="processed_text", n=10) -> DataFrame:
    """The most frequent words of one class, ties by word."""
    column = _label_column(scored)
    counts = _word_counts(scored.filter(F.col(column) == label), text, column)
    return counts.orderBy(F.desc("n"), "word").limit(n).select("word", "n")


def top_words_per_label(scored: DataFrame, text="processed_text", n=10) -> DataFrame:
    """The same for every class at once.

    Spark applies the rank limit in each task before the shuffle, so a class
    sends at most ``n`` words per task.
    """
    ranked = Window.partitionBy("label").orderBy(F.desc("n"), "word")
    counts = _word_counts(scored, text, _label_column(scored)).filter(F.col("label").isNotNull())
    return counts.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= n)
