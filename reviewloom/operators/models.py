"""Training and selection of the sentiment model."""

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel, NaiveBayes, NaiveBayesModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.labels import label_index, label_name, text_representation
from reviewloom.functions.text import preprocess
from reviewloom.operators import features as X
from reviewloom.operators import logistic
from reviewloom.operators.metrics import classification_report
from reviewloom.schema import LABELS
from reviewloom.session import stage

LABEL, WEIGHT = "_label", "_weight"
RAW, PROBABILITY, PREDICTION = "_model_raw", "_model_probability", "_model_prediction"

# The five configurations compared before the final fit.
EXPERIMENTS = (
    {"exp_no": 1, "text_option": "A", "n_max": 1, "class_weight": "balanced"},
    {"exp_no": 2, "text_option": "A", "n_max": 2, "class_weight": "balanced"},
    {"exp_no": 3, "text_option": "B", "n_max": 1, "class_weight": "balanced"},
    {"exp_no": 4, "text_option": "B", "n_max": 2, "class_weight": "balanced"},
    {"exp_no": 5, "text_option": "B", "n_max": 2, "class_weight": "none"},
)

MAX_ITER = 1000


def class_weights(df: DataFrame, label="sentiment") -> DataFrame:
    """Per class: n / (classes * rows of the class)."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n") / F.count(F.lit(1))).scalar()
    return counts.withColumn("weight", totals / F.col("n"))


def balanced_weights(df: DataFrame, label="sentiment", out=WEIGHT) -> DataFrame:
    """Add the balancing weight of each row's class; classes are few."""
    weights = class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(F.broadcast(weights), label, "left")


def fit_logistic(
    train: DataFrame, c=1.0, max_iter=MAX_ITER, tol=1e-5, features=X.FEATURES, entries_per_task=logistic.ENTRIES_PER_TASK
) -> LogisticRegressionModel:
    """Multinomial logistic regression with an L2 penalty of strength 1 / ``c``.

    ``train`` holds the vector, the label index and the row weight. The fit
    ends when no entry of the gradient is above ``tol`` per unit of weight; the
    model's ``training`` tells whether it did. Every step is a pass over the
    rows, which are staged as packed sparse lists until it ends. As many tasks read them as have
    ``entries_per_task`` entries each, but one a core at most: each adds a vector of
    the size of the weights to the sum of a pass.
    """
    parts = X.sparse_parts(features)
    rows = train.select(
        F.col(LABEL).cast("int").alias("label"),
        F.col(WEIGHT).cast("double").alias("weight"),
        parts["indices"].alias("indices"),
        parts["values"].alias("values"),
    )
    masses = [F.coalesce(F.sum(F.when(F.col(LABEL) == k, F.col(WEIGHT))), F.lit(0.0)).alias(f"m{k}") for k in range(len(LABELS))]
    facts = train.agg(
        F.sum(F.size(parts["indices"]).cast("long")).alias("entries"), F.first(parts["size"]).alias("width"), *masses
    ).first()
    if facts.entries is None:
        raise ValueError("no rows to fit a model on")
    spark = train.sparkSession
    tasks = max(1, min(facts.entries // entries_per_task, spark.sparkContext.defaultParallelism))
    packed = rows.repartition(tasks).mapInArrow(logistic.pack, logistic.PACKED)
    with logistic.staged(packed, tasks) as packed:
        weights, intercepts, training = logistic.fit(packed, facts[2:], facts.width, 1.0 / c, max_iter, tol)
    columns = {"featuresCol": features, "labelCol": LABEL, "weightCol": WEIGHT, "rawPredictionCol": RAW}
    columns |= {"probabilityCol": PROBABILITY, "predictionCol": PREDICTION, "maxIter": max_iter, "tol": tol}
    model = logistic.as_model(
        spark, weights, intercepts, standardization=False, regParam=1.0 / c, family="multinomial", **columns
    )
    model.training = training
    return model


def fit_naive_bayes(train: DataFrame, smoothing=1.0, features=X.FEATURES):
    """Multinomial naive Bayes on TF-IDF weights.

    Spark smooths the class priors too. ``naive_bayes_table`` does not.
    """
    return NaiveBayes(
        modelType="multinomial",
        smoothing=smoothing,
        featuresCol=features,
        labelCol=LABEL,
        rawPredictionCol=RAW,
        probabilityCol=PROBABILITY,
        predictionCol=PREDICTION,
    ).fit(train)


def naive_bayes_table(weights: DataFrame, rows: DataFrame, label="sentiment", smoothing=1.0):
    """Naive Bayes from a long TF-IDF table: terms and priors, each with a column per class.

    ``weights`` carries the label of its row; ``rows`` are all training rows.
    ``terms`` has the logarithm of each term's share of a class, ``priors``, one
    row, that of each class's share of the rows (NULL for a class without rows).
    One row per term is all that leaves the aggregation.
    """
    sums = weights.groupBy("term").agg(
        *[F.coalesce(F.sum(F.when(F.col(label) == c, F.col("weight"))), F.lit(0.0)).alias(c) for c in LABELS]
    )
    sums = stage(sums, "naive-bayes-sums")
    masses = F.struct(*[(F.sum(c) + smoothing * F.count(F.lit(1))).alias(c) for c in LABELS])
    masses = sums.agg(masses.alias("m")).scalar()
    terms = sums.select("term", *[F.log((F.col(c) + smoothing) / masses[c]).alias(c) for c in LABELS])
    counts = rows.filter(F.col(label).isin(*LABELS)).agg(
        F.count(F.lit(1)).alias("_all"), *[F.count_if(F.col(label) == c).alias(c) for c in LABELS]
    )
    return terms, counts.select(*[F.log(F.nullif(F.col(c), F.lit(0)) / F.col("_all")).alias(c) for c in LABELS])


def by_class(table: DataFrame, value: str, *keep: str) -> DataFrame:
    """A table with a column per class as rows (kept columns, class, value); NULL values left out."""
    return table.unpivot(list(keep), list(LABELS), "class", value).filter(F.col(value).isNotNull())


def score_naive_bayes(weights: DataFrame, ids: DataFrame, terms: DataFrame, priors: DataFrame, id_col: str) -> DataFrame:
    """Most probable class per id; rows without a known term get the prior.

    The model is joined on the term; Spark broadcasts it where its staged size
    is small, and else splits a term of very many rows.
    """
    terms = stage(terms, "naive-bayes-terms")
    sums = weights.join(terms, "term").groupBy(id_col).agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in LABELS])
    prior = priors.select(F.struct(*LABELS).alias("p")).scalar()
    scored = ids.select(id_col).join(sums, id_col, "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0.0)) + F.coalesce(prior[c], F.lit(float("-inf"))) for c in LABELS}
    )
    best = F.greatest(*LABELS)
    label = F.when(F.col(LABELS[0]) == best, LABELS[0])
    for c in LABELS[1:]:
        label = label.when(F.col(c) == best, c)
    return scored.select(
        id_col, label.alias("predicted_sentiment"), *[F.col(c).alias(f"log_score_{c}") for c in LABELS]
    )


def model_text(option="B", text_mode="raw"):
    """The text a model reads: the chosen columns, raw or preprocessed."""
    text = text_representation(option)
    if text_mode == "raw":
        return text
    if text_mode == "processed":
        return preprocess(text)
    raise ValueError(f"text mode must be 'raw' or 'processed', not {text_mode!r}")


def untrainable_rows(df: DataFrame, label="sentiment") -> int:
    """The number of rows without one of the fixed labels, which no model is trained on."""
    return df.filter(~F.coalesce(F.col(label).isin(*LABELS), F.lit(False))).count()


def training_rows(df: DataFrame, label="sentiment") -> DataFrame:
    """Rows with one of the fixed labels, with its index; ``untrainable_rows`` counts the others."""
    return df.filter(F.col(label).isin(*LABELS)).withColumn(LABEL, label_index(label))


def _weighted(train, class_weight, label):
    if class_weight == "balanced":
        return balanced_weights(train, label)
    return train.withColumn(WEIGHT, F.lit(1.0))


def fit_sentiment_model(
    train: DataFrame,
    text_option="B",
    n_max=2,
    class_weight="balanced",
    text_mode="raw",
    min_df=X.MIN_DF,
    max_features=X.MAX_FEATURES,
    label="sentiment",
    classifier="logistic",
    **solver,
):
    """Features and classifier in one pipeline, and the settings its scorer needs.

    ``classifier``: ``logistic``, with the options of ``fit_logistic``, or
    ``naive_bayes``, which is one pass and takes no class weights. The texts are staged once, so that rows are prepared and preprocessed
    once for the vocabulary and the vectors. The vectors are staged once as well: the solver then reads them in every
    iteration without building the features again, whatever executors are lost.
    """
    rows = training_rows(train, label).select(F.col(label), LABEL, model_text(text_option, text_mode).alias("_text"))
    rows = stage(rows, "model-texts")
    features = X.fit_features(rows, "_text", n_max, min_df, max_features, staged=True)
    vectors = stage(X.transform_features(features, rows, "_text").select(label, LABEL, X.FEATURES), "vectors")
    if classifier == "naive_bayes":
        fitted, class_weight = fit_naive_bayes(vectors, **solver), "none"
    elif classifier == "logistic":
        fitted = fit_logistic(_weighted(vectors, class_weight, label), **solver)
    else:
        raise ValueError(f"classifier must be 'logistic' or 'naive_bayes', not {classifier!r}")
    settings = {
        "text_option": text_option,
        "n_max": n_max,
        "class_weight": class_weight,
        "text_mode": text_mode,
        "classifier": classifier,
        "vocabulary_size": len(X.feature_terms(features)),
        "untrainable_rows": untrainable_rows(train, label),
    }
    if classifier == "logistic":
        settings |= {"iterations": fitted.training.iterations, "converged": fitted.training.converged}
    return PipelineModel(features.stages + [fitted]), settings


def _metrics_row(scored, label):
    report = {r.row: r for r in classification_report(scored, label).collect()}
    macro = report["macro avg"]
    row = {
        "accuracy": report["accuracy"].f1,
        "macro_precision": macro.precision,
        "macro_recall": macro.recall,
        "macro_f1": macro.f1,
        "weighted_f1": report["weighted avg"].f1,
    }
    for c in LABELS:
        row |= {f"{m}_{c}": report[c][m] for m in ("precision", "recall", "f1")}
    return row


def run_experiments(
    train: DataFrame,
    val: DataFrame,
    grid=EXPERIMENTS,
    text_mode="raw",
    min_df=X.MIN_DF,
    max_features=X.MAX_FEATURES,
    label="sentiment",
    parallelism=3,
    **solver,
) -> DataFrame:
    """Fit every configuration on ``train`` and measure it on ``val``.

    One row per configuration. Configurations that read the same text share
    staged texts, and those that read the same terms one staged feature table.
    ``parallelism`` fits run side by side, as a pass of one alone leaves cores
    idle between its jobs.
    """
    spark = train.sparkSession
    texts, staged = {}, {}
    fits = []
    for config in grid:
        started = time.monotonic()
        key = (config["text_option"], config["n_max"])
        if key[0] not in texts:
            text = model_text(key[0], text_mode).alias("_text")
            texts[key[0]] = [stage(training_rows(df, label).select(label, LABEL, text), "model-texts") for df in (train, val)]
        if key not in staged:
            parts = texts[key[0]]
            fitted = X.fit_features(parts[0], "_text", config["n_max"], min_df, max_features, staged=True)
            vectors = [
                stage(X.transform_features(fitted, p, "_text").select(label, LABEL, X.FEATURES), "vectors")
                for p in parts
            ]
            sizes = {"n_features": len(X.feature_terms(fitted)), "n_train": vectors[0].count(), "n_val": vectors[1].count()}
            staged[key] = *vectors, sizes
        fits.append((config, *staged[key], time.monotonic() - started))

    def measured(config, fit_rows, val_rows, sizes, seconds):
        started = time.monotonic()
        classifier = fit_logistic(_weighted(fit_rows, config["class_weight"], label), **solver)
        scored = classifier.transform(val_rows).select(label, label_name(PREDICTION).alias("predicted_sentiment"))
        metrics = _metrics_row(scored, label)
        training = classifier.training
        ended = {"iterations": training.iterations, "converged": training.converged}
        return {**config, **sizes, **metrics, **ended, "fit_seconds": seconds + time.monotonic() - started}

    with ThreadPoolExecutor(parallelism) as pool:
        rows = list(pool.map(inheritable_thread_target(spark)(lambda fit: measured(*fit)), fits))
    columns = list(rows[0])
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], columns)


def select_best(results: DataFrame) -> DataFrame:
    """The configuration with the highest macro F1, the first one on ties."""
    return results.orderBy(F.desc("macro_f1"), "exp_no").limit(1)


def train_final(train: DataFrame, val: DataFrame, best, **options):
    """Refit features and classifier on train and validation together."""
    return fit_sentiment_model(
        train.unionByName(val),
        text_option=best["text_option"],
        n_max=best["n_max"],
        class_weight=best["class_weight"],
        **options,
    )


def solver_gradient(rows: DataFrame, model: LogisticRegressionModel, c=1.0, features=X.FEATURES) -> DataFrame:
    """(class, n_rows, gradient) of the penalised loss at the fitted coefficients.

    ``rows`` holds the vectors, label indices and weights that ``model`` was
    fitted on; ``gradient`` is the largest entry, per unit of weight, in
    absolute value. Every row adds its entries in place, and only one sum for
    each term is shuffled.
    """
    classes = range(len(LABELS))
    parts = X.sparse_parts(features)
    scored = model.transform(rows).withColumn("_p", vector_to_array(PROBABILITY))
    errors = [(F.col("_p")[k] - (F.col(LABEL) == k).cast("double")) * F.col(WEIGHT) for k in classes]
    entries = scored.select(
        *[e.alias(f"e{k}") for k, e in enumerate(errors)],
        F.inline(F.arrays_zip(parts["indices"].alias("i"), parts["values"].alias("x"))),
    )
    sums = entries.groupBy("i").agg(*[F.sum(F.col(f"e{k}") * F.col("x")).alias(f"g{k}") for k in classes])
    matrix = model.coefficientMatrix.toArray()
    kept = [(i, *(float(matrix[k, i]) for k in classes)) for i in range(matrix.shape[1])]
    kept = rows.sparkSession.createDataFrame(kept, "i int, " + ", ".join(f"w{k} double" for k in classes))
    slopes = [F.max(F.abs(F.coalesce(F.col(f"g{k}"), F.lit(0.0)) + F.col(f"w{k}") / c)).alias(f"m{k}") for k in classes]
    largest = kept.join(sums, "i", "left").agg(*slopes)
    counts = scored.agg(
        *[F.count_if(F.col(LABEL) == k).alias(f"n{k}") for k in classes],
        *[F.abs(F.sum(e)).alias(f"b{k}") for k, e in enumerate(errors)],
        F.sum(WEIGHT).alias("total"),
    )
    row = counts.withColumn("_m", largest.select(F.struct(*[f"m{k}" for k in classes])).scalar())
    lines = [
        F.struct(
            F.lit(label).alias("class"),
            F.col(f"n{k}").alias("n_rows"),
            (F.greatest(f"_m.m{k}", f"b{k}") / F.col("total")).alias("gradient"),
        )
        for k, label in enumerate(LABELS)
    ]
    return row.select(F.inline(F.array(*lines)))


def _class_weights(model):
    """One row of weights per class: coefficients, or the log shares of naive Bayes."""
    for s in model.stages:
        if isinstance(s, LogisticRegressionModel):
            return s.coefficientMatrix.toArray()
        if isinstance(s, NaiveBayesModel):
            return s.theta.toArray()
    raise ValueError("the pipeline has no classifier with a weight per term")


def term_coefficients(spark, model: PipelineModel) -> DataFrame:
    """(term, weight per class) of the fitted classifier; one row per term."""
    matrix = _class_weights(model)
    rows = [
        (term, *[float(matrix[k, i]) for k in range(len(LABELS))]) for i, term in enumerate(X.feature_terms(model))
    ]
    return spark.createDataFrame(rows, "term string, " + ", ".join(f"weight_{c} double" for c in LABELS))


def feature_contributions(df: DataFrame, model: PipelineModel, text: str, id_col: str) -> DataFrame:
    """Per row and known term: TF-IDF, class weights and their products."""
    coefficients = F.broadcast(term_coefficients(df.sparkSession, model))
    table = X.tfidf_table(df, PipelineModel(model.stages[:-1]), text, id_col).withColumnRenamed("weight", "tfidf")
    return table.join(coefficients, "term").withColumns(
        {f"contribution_{c}": F.col("tfidf") * F.col(f"weight_{c}") for c in LABELS}
    )


def unknown_terms(df: DataFrame, model: PipelineModel, text: str, id_col: str) -> DataFrame:
    """Per row: its distinct terms that the vocabulary lacks."""
    known = df.sparkSession.createDataFrame([(t,) for t in X.feature_terms(model)], "term string")
    terms = PipelineModel(model.stages[:2]).transform(df.select(id_col, F.col(text).alias(X.TEXT)))
    return terms.select(id_col, F.explode(F.array_distinct(X.TERMS)).alias("term")).join(
        F.broadcast(known), "term", "left_anti"
    )
