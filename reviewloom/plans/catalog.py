"""Every operator as a named query over the sample tables.

Each callable takes (spark, sf_dir) and returns a DataFrame; each reads its
tables whole. Floats are rounded to 6 digits so that two engines agree.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.functions import labels as L
from reviewloom.functions import text as TX
from reviewloom.functions.gate import domain_gate
from reviewloom.operators import audit as A
from reviewloom.operators import cleaning as C
from reviewloom.operators import features as X
from reviewloom.operators import incremental as I
from reviewloom.operators import metrics as V
from reviewloom.operators import models as M
from reviewloom.operators import scoring as R
from reviewloom.operators import sketches as K
from reviewloom.operators import splitting as G
from reviewloom.plans.sample_reviews import labelled_reviews, sample_reviews, scored_reviews, table
from reviewloom.plans.scoring_job import score_folder, score_upload
from reviewloom.schema import LABELS
from reviewloom.session import stage, stage_path
from reviewloom.sources import reviews as S
from reviewloom.sources import tables as ST
from reviewloom.streaming import summary as W
from reviewloom.streaming.scoring import score_stream

QUERIES = {}

# Largest entry of the gradient, per unit of weight, at which the loss counts as minimal.
GRADIENT_BELOW = 1e-3

KEYWORDS = ("the", "and", "les", "der", "with", "ing", "nowhere")

FLAGSHIP = "category_class_distribution"


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits=6) -> DataFrame:
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def prepared(spark, sf_dir, products=97):
    return C.prepare_reviews(sample_reviews(spark, sf_dir, products))


# Whole pipeline, first slice


@query
def category_class_distribution(spark, sf_dir):
    """Classes per category after cleaning."""
    clean = C.clean_reviews(sample_reviews(spark, sf_dir))
    return A.crosstab(clean, "product_category", "sentiment", LABELS)


# Sources and sinks


@query
def csv_round_trip(spark, sf_dir):
    """Reviews written as CSV and read with the review schema."""
    path = stage_path(spark, "reviews-csv")
    ST.write_table(sample_reviews(spark, sf_dir), path, "csv")
    return S.read_reviews(spark, path, file_format="csv")


@query
def partitioned_write(spark, sf_dir):
    """A table partitioned by language; one partition read back per group."""
    path = stage_path(spark, "by-language")
    ST.write_table(sample_reviews(spark, sf_dir), path, partition_by=["language"])
    back = spark.read.parquet(path)
    return back.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.sum("stars").alias("sum_stars"))


@query
def report_round_trip(spark, sf_dir):
    """The audit document written and read back as JSON."""
    path = stage_path(spark, "audit-report")
    ST.write_report(A.audit_report(sample_reviews(spark, sf_dir)), path)
    schema = (
        "shape struct<n_rows bigint, n_columns bigint>, distinct_ids struct<review_id bigint, product_id bigint>, "
        "duplicates struct<review_bodies bigint, review_titles bigint>"
    )
    return spark.read.schema(schema).json(path).select(
        "shape.n_rows",
        "shape.n_columns",
        F.col("distinct_ids.review_id").alias("distinct_reviews"),
        F.col("distinct_ids.product_id").alias("distinct_products"),
        F.col("duplicates.review_bodies").alias("duplicate_bodies"),
        F.col("duplicates.review_titles").alias("duplicate_titles"),
    )


@query
def detected_text_column(spark, sf_dir):
    """Characters of the column found in each table with text."""
    parts = []
    for name in ("documents", "benchmark", "conversations"):
        df = S.validate_input(table(spark, sf_dir, name))
        column = S.detect_text_column(df)
        parts.append(
            df.agg(F.sum(F.length(column)).alias("n_chars")).select(
                F.lit(name).alias("table_name"), F.lit(column).alias("text_column"), "n_chars"
            )
        )
    return G.union_splits(*parts)


# Labels and predicates


@query
def star_labels(spark, sf_dir):
    d = sample_reviews(spark, sf_dir)
    odd = F.when(F.col("review_id") % 11 == 0, F.lit(None)).otherwise((F.col("review_id") % 8).cast("int"))
    return d.select("review_id", L.star_sentiment("stars").alias("sentiment"), L.star_sentiment(odd).alias("odd_sentiment"))


@query
def rating_labels(spark, sf_dir):
    rating = F.when(F.col("review_id") % 13 != 0, F.col("review_id") % 11 / 2.0)
    return sample_reviews(spark, sf_dir).select(
        "review_id", rating.alias("rating"), L.rating_sentiment(rating).alias("sentiment")
    )


@query
def normalized_texts(spark, sf_dir):
    return L.normalize_reviews(sample_reviews(spark, sf_dir)).select("review_id", "review_title", "review_body")


@query
def text_options(spark, sf_dir):
    return sample_reviews(spark, sf_dir).select(
        "review_id",
        F.md5(L.text_representation("A")).alias("text_a"),
        F.md5(L.text_representation("B")).alias("text_b"),
    )


@query
def invalid_star_rows(spark, sf_dir):
    odd = sample_reviews(spark, sf_dir).withColumn(
        "stars", F.when(F.col("review_id") % 11 != 0, (F.col("review_id") % 8).cast("int"))
    )
    return L.invalid_star_filter(odd).select("review_id", "stars")


@query
def correct_flags(spark, sf_dir):
    return scored_reviews(spark, sf_dir).select(
        "review_id", L.correct_flag("predicted_sentiment", "sentiment").alias("correct")
    )


# Text functions


@query
def expanded_contractions(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("documents").alias("source"), "text")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("pages").alias("source"), F.col("html").alias("text"))
    apostrophes = F.regexp_replace("text", "(ent|ing|on)( )", "n't$2")
    return texts.unionByName(pages).select(
        "id", "source", F.md5(TX.expand_contractions("text")).alias("plain"), F.md5(TX.expand_contractions(apostrophes)).alias("contracted")
    )


@query
def cleaned_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", TX.clean_text("text").alias("cleaned_text"))


@query
def cleaned_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", TX.clean_text("html").alias("cleaned_html"), TX.clean_text("url").alias("cleaned_url")
    )


@query
def token_lists(spark, sf_dir):
    tokens = TX.tokenize("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.md5(F.array_join(tokens, ",")).alias("tokens")
    )


@query
def kept_tokens(spark, sf_dir):
    kept = TX.remove_stopwords(TX.tokenize("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(kept).cast("long").alias("n_kept"), F.md5(F.array_join(kept, ",")).alias("kept")
    )


@query
def suffix_lemmas(spark, sf_dir):
    lemmas = TX.lemmatize(TX.tokenize("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lemmas, ",").alias("lemmas"))


@query
def table_lemmas(spark, sf_dir):
    """Lemmas from a table: each token that ends in -e maps to its stem."""
    docs = stage(table(spark, sf_dir, "documents").select("doc_id", TX.tokenize("text").alias("tokens")), "tokens")
    lemmas = (
        docs.select(F.explode("tokens").alias("token"))
        .distinct()
        .filter(F.col("token").endswith("e") & (F.length("token") > 3))
        .select("token", F.expr("left(token, length(token) - 1)").alias("lemma"))
    )
    return TX.lemmatize_with_table(docs, "tokens", stage(lemmas, "lemmas"), "doc_id").select(
        "doc_id", F.array_join("lemmas", ",").alias("lemmas")
    )


@query
def preprocessed_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", TX.preprocess("text").alias("processed_text"))


@query
def text_steps(spark, sf_dir):
    steps = TX.nlp_steps(table(spark, sf_dir, "conversations"), "text")
    s = F.col("nlp_steps")
    return steps.select(
        "conv_id",
        "turn",
        s["cleaned_text"].alias("cleaned_text"),
        F.array_join(s["tokens"], " ").alias("tokens"),
        F.array_join(s["filtered_tokens"], " ").alias("filtered_tokens"),
        F.array_join(s["lemmatized_tokens"], " ").alias("lemmatized_tokens"),
        s["processed_text"].alias("processed_text"),
        s["num_tokens"].alias("num_tokens"),
    )


@query
def gated_turns(spark, sf_dir):
    gate = domain_gate("text")
    return table(spark, sf_dir, "conversations").withColumn("g", gate).select(
        "conv_id", "turn", "g.is_product_feedback", "g.domain_status", "g.message"
    )


@query
def gated_documents(spark, sf_dir):
    """Documents by gate message, with one word swapped in a part of them, and their languages as short texts."""
    swapped = F.when(F.col("doc_id") % 4 == 0, F.regexp_replace("text", r"\b(?:on|la|der)\b", "quality")).when(
        F.col("doc_id") % 4 == 1, F.regexp_replace("text", r"\b(?:the|le|die)\b", "fever")
    ).otherwise(F.col("text"))
    texts = F.array(
        F.struct(F.lit("text").alias("part"), swapped.alias("text")), F.struct(F.lit("lang").alias("part"), F.col("lang").alias("text"))
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", F.inline(texts))
    return rows.select("doc_id", "part", domain_gate("text").alias("g")).select(
        "doc_id", "part", "g.is_product_feedback", "g.message"
    )


@query
def join_keys(spark, sf_dir):
    """Of the benchmark the key itself, of every document its digest."""
    items = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("b"), "item_id").alias("item"), TX.normalize_join_text("text").alias("join_text")
    )
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("item"), F.md5(TX.normalize_join_text("text").cast("binary")).alias("join_text")
    )
    return items.unionByName(docs)


# Audit


@query
def table_shape(spark, sf_dir):
    return A.shape(sample_reviews(spark, sf_dir))


@query
def column_profile(spark, sf_dir):
    """Types, NULLs and blanks per column in one pass."""
    return A.column_profile(sample_reviews(spark, sf_dir))


@query
def null_counts(spark, sf_dir):
    return A.null_counts(sample_reviews(spark, sf_dir))


@query
def blank_counts(spark, sf_dir):
    reviews = sample_reviews(spark, sf_dir).withColumn(
        "review_title", F.when(F.col("review_id") % 5 == 0, " \n ").otherwise(F.col("review_title"))
    )
    return A.blank_counts(reviews)


@query
def invalid_star_count(spark, sf_dir):
    odd = sample_reviews(spark, sf_dir).withColumn(
        "stars", F.when(F.col("review_id") % 11 != 0, (F.col("review_id") % 8).cast("int"))
    )
    return A.invalid_star_count(odd)


@query
def language_counts(spark, sf_dir):
    return A.value_counts(sample_reviews(spark, sf_dir), "language")


@query
def category_counts(spark, sf_dir):
    return A.value_counts(sample_reviews(spark, sf_dir), "product_category")


@query
def star_counts(spark, sf_dir):
    return A.value_counts(sample_reviews(spark, sf_dir), "stars", by_value=True)


@query
def sentiment_shares(spark, sf_dir):
    return rounded(A.value_share(prepared(spark, sf_dir), "sentiment"))


@query
def distinct_ids(spark, sf_dir):
    return A.distinct_counts(sample_reviews(spark, sf_dir))


@query
def distinct_ids_approximate(spark, sf_dir):
    """The exact counts, and whether the approximate ones are within three times their stated error of 5 percent."""
    reviews = sample_reviews(spark, sf_dir)
    exact = A.distinct_counts(reviews)
    near = A.distinct_counts(reviews, approximate=True).select(F.struct("*").alias("n")).scalar()
    close = [(F.abs(near[c] - F.col(c)) <= 0.15 * F.col(c)).alias(f"{c}_close") for c in exact.columns]
    return exact.select("*", *close)


@query
def duplicate_complete_rows(spark, sf_dir):
    """Complete rows without their id, stacked twice for one source."""
    reviews = sample_reviews(spark, sf_dir).drop("review_id")
    return A.duplicate_rows(reviews.unionByName(reviews.filter(F.col("product_id").startswith("src1:"))))


@query
def duplicate_bodies(spark, sf_dir):
    return A.duplicate_values(sample_reviews(spark, sf_dir), "review_body")


@query
def duplicate_titles(spark, sf_dir):
    return A.duplicate_values(sample_reviews(spark, sf_dir), "review_title", drop_null=True)


@query
def reviews_per_product(spark, sf_dir):
    return rounded(A.group_size_stats(sample_reviews(spark, sf_dir, 7), "product_id"))


@query
def reviews_per_reviewer(spark, sf_dir):
    return rounded(A.group_size_stats(sample_reviews(spark, sf_dir), "reviewer_id"))


@query
def text_length_stats(spark, sf_dir):
    return rounded(A.length_stats(sample_reviews(spark, sf_dir)))


@query
def category_by_sentiment(spark, sf_dir):
    return A.category_by_sentiment(sample_reviews(spark, sf_dir))


@query
def category_by_stars(spark, sf_dir):
    return A.category_by_stars(sample_reviews(spark, sf_dir))


@query
def audit_report(spark, sf_dir):
    return A.audit_report(sample_reviews(spark, sf_dir))


@query
def audit_entries(spark, sf_dir):
    """All sections of that document as rows."""
    return A.audit_entries(sample_reviews(spark, sf_dir))


@query
def audit_document_entries(spark, sf_dir):
    """The same rows out of the JSON document, parsed whole."""
    sections = F.from_json("report", "map<string, map<string, string>>")
    rows = A.audit_report(sample_reviews(spark, sf_dir)).select(F.explode(sections).alias("section", "members"))
    rows = rows.select("section", F.explode("members").alias("key", "value"))
    inner = rows.filter(F.col("section").isin(*A.NESTED)).select(
        "section", F.col("key").alias("outer"), F.explode(F.from_json("value", "map<string, string>")).alias("name", "value")
    )
    inner = inner.select("section", F.concat_ws(".", "outer", "name").alias("key"), "value")
    entries = rows.filter(~F.col("section").isin(*A.NESTED)).unionByName(inner)
    # numbers with a fraction come back without their last zeros
    fraction = F.col("section").isin("sentiment_percent", "reviews_per_id", "text_lengths")
    return entries.withColumn("value", F.when(fraction, F.format_string("%.6f", F.col("value").cast("double"))).otherwise(F.col("value")))


# Duplicates and cleaning


@query
def duplicate_groups(spark, sf_dir):
    return C.duplicate_groups(prepared(spark, sf_dir))


@query
def duplicate_summary(spark, sf_dir):
    return C.duplicate_summary(prepared(spark, sf_dir))


def _ids(df):
    return df.select("review_id", "product_id", "stars", "sentiment", F.md5("review_body").alias("body_md5"))


@query
def without_conflicts(spark, sf_dir):
    return _ids(C.drop_conflicting(prepared(spark, sf_dir)))


@query
def first_per_body(spark, sf_dir):
    return _ids(C.dedup_keep_first(prepared(spark, sf_dir)))


@query
def without_empty_bodies(spark, sf_dir):
    reviews = prepared(spark, sf_dir).withColumn(
        "review_body", F.when(F.col("review_id") % 10 == 3, " \n ").otherwise(F.col("review_body"))
    )
    return _ids(C.drop_empty_body(reviews))


@query
def clean_reviews(spark, sf_dir):
    return C.clean_reviews(sample_reviews(spark, sf_dir)).withColumns(
        {"review_body": F.md5("review_body"), "review_title": F.md5("review_title")}
    )


@query
def clean_reviews_staged(spark, sf_dir):
    """The same rows through the staged table of repeated bodies."""
    reviews = sample_reviews(spark, sf_dir)
    repeated = stage(C.repeated_bodies(C.prepare_reviews(reviews)), "repeated-bodies")
    return _ids(C.clean_reviews(reviews, repeated=repeated))


@query
def cleaning_report(spark, sf_dir):
    return rounded(C.cleaning_report(sample_reviews(spark, sf_dir)))


# Splits


@query
def group_split(spark, sf_dir):
    return G.group_split(prepared(spark, sf_dir, 7), seed=42).select("review_id", "product_id", "split")


@query
def seed_divergence(spark, sf_dir):
    return rounded(G.seed_scores(prepared(spark, sf_dir, 7)).select("seed", "divergence"))


@query
def best_group_split(spark, sf_dir):
    reviews, seed, divergence = G.best_group_split(prepared(spark, sf_dir, 7))
    return reviews.select(
        "review_id", "split", F.lit(seed).alias("seed"), F.round(F.lit(divergence), 6).alias("divergence")
    )


@query
def split_leakage(spark, sf_dir):
    """Shared products of a sound split and of one that ignores products."""
    reviews = prepared(spark, sf_dir, 7)
    rows = G.group_split(reviews.withColumn("review_key", F.col("review_id").cast("string")), key="review_key")
    sound = G.split_leakage(G.group_split(reviews)).withColumn("kind", F.lit("by product"))
    return sound.unionByName(G.split_leakage(rows).withColumn("kind", F.lit("by review")))


@query
def split_report(spark, sf_dir):
    return rounded(G.split_report(G.group_split(prepared(spark, sf_dir, 7))))


@query
def stratified_split(spark, sf_dir):
    return G.stratified_split(prepared(spark, sf_dir)).select("review_id", "sentiment", "split")


@query
def stacked_splits(spark, sf_dir):
    reviews = prepared(spark, sf_dir)
    english = F.col("language") == "en"
    parts = [G.with_split(reviews.filter(english), "en"), G.with_split(reviews.filter(~english | english.isNull()), "other")]
    return G.union_splits(*parts).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("stars").alias("sum_stars"))


@query
def sample_per_class(spark, sf_dir):
    return G.sample_per_class(prepared(spark, sf_dir), 20).select("review_id", "sentiment")


# Features


def _texts(spark, sf_dir):
    return sample_reviews(spark, sf_dir).select("review_id", L.text_representation("B").alias("text"))


@query
def term_token_lists(spark, sf_dir):
    words = X.with_terms(_texts(spark, sf_dir), "text", 1)
    return words.select(
        "review_id", F.size("terms").cast("long").alias("n_terms"), F.md5(F.array_join("terms", ",")).alias("terms")
    )


@query
def ngram_lists(spark, sf_dir):
    terms = X.with_terms(_texts(spark, sf_dir), "text", 2)
    return terms.select(
        "review_id", F.size("terms").cast("long").alias("n_terms"), F.md5(F.array_join("terms", ",")).alias("terms")
    )


@query
def vocabulary(spark, sf_dir):
    return X.vocabulary(X.with_terms(_texts(spark, sf_dir), "text", 1), n_max=2)


@query
def vocabulary_prefiltered(spark, sf_dir):
    """The same through hash cells."""
    return X.vocabulary(X.with_terms(_texts(spark, sf_dir), "text", 1), prefilter_cells=2**22, n_max=2)


@query
def term_idf(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    n = texts.agg(F.count(F.lit(1))).scalar()
    return rounded(X.idf(X.vocabulary(X.with_terms(texts, "text", 1)), n))


@query
def tfidf_weights(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    return rounded(X.tfidf_table(texts, X.fit_features(texts, "text", 1), "text", "review_id"))


@query
def tfidf_weights_sublinear(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    model = X.fit_features(texts, "text", 2, X.LEGACY_MIN_DF, X.LEGACY_MAX_FEATURES)
    return rounded(X.tfidf_table(texts, model, "text", "review_id", sublinear=True))


@query
def features_of_unseen(spark, sf_dir):
    """Vocabulary from the train split, applied to the others."""
    rows = G.group_split(prepared(spark, sf_dir, 7)).select("review_id", "split", L.text_representation("B").alias("text"))
    model = X.fit_features(rows.filter("split = 'train'"), "text", 1)
    features = X.feature_stats(X.transform_features(model, rows.filter("split != 'train'"), "text"), model)
    return features.select("review_id", "split", "num_nonzero_features", "vocabulary_size")


@query
def weights_of_unseen(spark, sf_dir):
    """The weights behind those counts."""
    rows = G.group_split(prepared(spark, sf_dir, 7)).select("review_id", "split", L.text_representation("B").alias("text"))
    model = X.fit_features(rows.filter("split = 'train'"), "text", 1)
    return rounded(X.tfidf_table(rows.filter("split != 'train'"), model, "text", "review_id", "split"))


@query
def sublinear_vectors(spark, sf_dir):
    """The entries of the damped vectors as Spark ML has them, by the number of their term."""
    texts = _texts(spark, sf_dir)
    model = X.fit_features(texts, "text", 1, X.LEGACY_MIN_DF, X.LEGACY_MAX_FEATURES)
    parts = X.sparse_parts(X.FEATURES)
    entries = F.arrays_zip(parts["indices"].alias("term_index"), parts["values"].alias("weight"))
    return rounded(X.sublinear_features(texts, model, "text").select("review_id", F.inline(entries)))


# Models


@query
def class_weights(spark, sf_dir):
    return rounded(M.class_weights(labelled_reviews(spark, sf_dir)))


@query
def row_weights(spark, sf_dir):
    rows = M.balanced_weights(labelled_reviews(spark, sf_dir), out="weight")
    return rounded(rows.select("review_id", "sentiment", "weight"))


def _bayes(spark, sf_dir):
    texts = labelled_reviews(spark, sf_dir).select("review_id", "sentiment", L.text_representation("B").alias("text"))
    weights = X.tfidf_table(texts, X.fit_features(texts, "text", 1), "text", "review_id", "sentiment")
    return texts, weights, *M.naive_bayes_table(weights, texts)


@query
def naive_bayes_terms(spark, sf_dir):
    return rounded(M.by_class(_bayes(spark, sf_dir)[2], "log_prob", "term"))


@query
def naive_bayes_priors(spark, sf_dir):
    return rounded(M.by_class(_bayes(spark, sf_dir)[3], "log_prior"))


@query
def naive_bayes_scores(spark, sf_dir):
    texts, weights, terms, priors = _bayes(spark, sf_dir)
    return rounded(M.score_naive_bayes(weights, texts, terms, priors, "review_id"), 5)


@query
def naive_bayes_vectors(spark, sf_dir):
    """The Spark ML form on the damped vectors of the one-domain models."""
    texts = labelled_reviews(spark, sf_dir).select("review_id", "sentiment", TX.preprocess("review_body").alias("text"))
    model = X.fit_features(texts, "text", 2, X.LEGACY_MIN_DF, X.LEGACY_MAX_FEATURES)
    rows = X.sublinear_features(M.training_rows(texts), model, "text")
    scored = M.fit_naive_bayes(rows).transform(rows)
    return scored.select("review_id", "sentiment", L.label_name(M.PREDICTION).alias("predicted_sentiment"))


def _splits(spark, sf_dir):
    reviews = G.group_split(L.normalize_reviews(labelled_reviews(spark, sf_dir)))
    return [reviews.filter(F.col("split") == s) for s in G.SPLITS]


def _model(spark, sf_dir, **options):
    """The model of the scoring queries: naive Bayes, which SQL can express."""
    train, val, _ = _splits(spark, sf_dir)
    return M.fit_sentiment_model(train.unionByName(val), classifier="naive_bayes", **options)


@query
def experiment_results(spark, sf_dir):
    train, val, _ = _splits(spark, sf_dir)
    return M.run_experiments(train, val)


@query
def experiment_facts(spark, sf_dir):
    """What the fits of the experiments are made of, and whether each has reached the minimum."""
    train, val, _ = _splits(spark, sf_dir)
    results = M.run_experiments(train, val)
    return results.select("exp_no", "text_option", "n_max", "class_weight", "n_features", "n_train", "n_val", "converged")


@query
def solver_gradients(spark, sf_dir):
    """Rows per class, and whether the solver has reached a minimum of the loss."""
    train, _, _ = _splits(spark, sf_dir)
    rows = M.training_rows(train).select("sentiment", M.LABEL, M.model_text("A").alias("text"))
    features = X.fit_features(rows, "text", 1)
    vectors = stage(X.transform_features(features, rows, "text").select("sentiment", M.LABEL, X.FEATURES), "vectors")
    weighted = M.balanced_weights(vectors)
    found = M.solver_gradient(weighted, M.fit_logistic(weighted))
    return found.select("class", "n_rows", (F.col("gradient") < GRADIENT_BELOW).alias("at_minimum"))


@query
def best_of_results(spark, sf_dir):
    """Selection among predictions that each get one language wrong, and none."""
    scored = scored_reviews(spark, sf_dir)
    results = []
    for no, language in enumerate(("en", "fr", "de", "es", None), 1):
        wrong = F.lit(False) if language is None else F.col("language") == language
        trial = scored.withColumn("guess", F.when(wrong, "Neutral").otherwise(F.col("predicted_sentiment")))
        results.append(V.overall_metrics(trial, predicted="guess").select(F.lit(no).alias("exp_no"), "accuracy", "macro_f1"))
    return rounded(M.select_best(G.union_splits(*results)))


@query
def final_model_report(spark, sf_dir):
    """Refit on train and validation, measured on the test products."""
    train, val, test = _splits(spark, sf_dir)
    best = {"text_option": "B", "n_max": 2, "class_weight": "balanced"}
    model, settings = M.train_final(train, val, best)
    text = test.withColumn("text", M.model_text(settings["text_option"]))
    return rounded(V.classification_report(R.score_batch(text, model, "text")))


@query
def final_model_facts(spark, sf_dir):
    """Settings of that refit, and the rows of each class it is measured on."""
    train, val, test = _splits(spark, sf_dir)
    model, settings = M.train_final(train, val, {"text_option": "B", "n_max": 2, "class_weight": "balanced"})
    scored = R.score_batch(test.withColumn("text", M.model_text(settings["text_option"])), model, "text")
    kept = ("text_option", "n_max", "class_weight", "text_mode", "vocabulary_size", "untrainable_rows", "converged")
    facts = [F.lit(settings[k]).alias(k) for k in kept]
    supports = [F.count_if(F.col("sentiment") == c).alias(f"support_{c}") for c in LABELS]
    known = F.count_if(F.col("predicted_sentiment").isin(*LABELS)).alias("n_predicted")
    return scored.agg(*supports, known).select(*facts, "*")


# Scoring


@query
def scored_turns(spark, sf_dir):
    model, _ = _model(spark, sf_dir)
    return rounded(R.score_batch(table(spark, sf_dir, "conversations"), model, with_probabilities=True))


@query
def scored_turns_processed(spark, sf_dir):
    """A pipeline trained and applied on preprocessed text."""
    model, settings = _model(spark, sf_dir, text_mode="processed")
    return R.score_batch(
        table(spark, sf_dir, "conversations"), model, text_mode=settings["text_mode"], with_processed_text=True
    )


@query
def gated_scores(spark, sf_dir):
    model, _ = _model(spark, sf_dir)
    return _flat_answers(R.score_gated(table(spark, sf_dir, "conversations"), model))


def _flat_answers(answers):
    """The answers with their probabilities and counts as columns."""
    steps = F.col("nlp_steps")
    return answers.select(
        "conv_id",
        "turn",
        "is_valid_domain",
        "domain_status",
        "domain_message",
        "sentiment",
        "confidence",
        "predicted_class_probability",
        *[F.col("probabilities")[c].alias(f"percent_{c}") for c in LABELS],
        "cleaned_text",
        steps["processed_text"].alias("processed_text"),
        steps["num_tokens"].alias("num_tokens"),
        steps["num_nonzero_features"].alias("num_nonzero_features"),
        steps["vocabulary_size"].alias("vocabulary_size"),
        steps["model_used"].alias("model_used"),
    )


@query
def gate_decisions(spark, sf_dir):
    return R.gate_reviews(table(spark, sf_dir, "conversations")).select(
        "conv_id", "turn", "is_valid_domain", "domain_status", "domain_message", "cleaned_text"
    )


@query
def saved_pipeline_scores(spark, sf_dir):
    """Scores of a pipeline that was saved, looked up and loaded."""
    model, settings = _model(spark, sf_dir)
    path = stage_path(spark, "pipeline")
    ST.save_pipeline(model, path, **settings)
    loaded, kept = ST.load_pipeline(spark, stage_path(spark, "no-pipeline-here"), path)
    return R.score_batch(table(spark, sf_dir, "benchmark"), loaded, text_mode=kept["text_mode"])


@query
def score_summary(spark, sf_dir):
    scored = scored_reviews(spark, sf_dir)
    return R.score_summary(scored, S.detect_text_column(scored, "review_body"))


@query
def score_sample(spark, sf_dir):
    return R.score_sample(scored_reviews(spark, sf_dir), "review_body", "review_id")


@query
def top_words_positive(spark, sf_dir):
    scored = scored_reviews(spark, sf_dir).drop("sentiment")
    return R.top_words(scored.withColumn("processed_text", TX.preprocess("review_body")), "Positive")


@query
def top_words_per_label(spark, sf_dir):
    scored = scored_reviews(spark, sf_dir).withColumn("processed_text", TX.preprocess("review_body"))
    return R.top_words_per_label(scored)


@query
def streamed_scores(spark, sf_dir):
    """The turns as a file stream, scored by the gated job into a table."""
    model, _ = _model(spark, sf_dir)
    source = table(spark, sf_dir, "conversations")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/conversations*.parquet")
    path = stage_path(spark, "streamed")
    score_stream(stream, model, path, stage_path(spark, "stream-checkpoint")).awaitTermination()
    return _flat_answers(spark.read.parquet(path))


def _saved_model(spark, sf_dir):
    model, settings = _model(spark, sf_dir)
    path = stage_path(spark, "pipeline")
    ST.save_pipeline(model, path, **settings)
    return path


@query
def batch_scoring_job(spark, sf_dir):
    """One run of the job on an uploaded CSV file: its summary, and what it has written."""
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.regexp_replace("text", "^$", "."))
    path, output = stage_path(spark, "upload") + ".csv", stage_path(spark, "scored-upload")
    ST.write_table(turns, path, "csv")
    tables = score_upload(spark, path, _saved_model(spark, sf_dir), output, "text")
    counts = tables["scored"].groupBy("predicted_sentiment").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 4).alias("sum_confidence")
    )
    sample = tables["sample"].agg(F.count(F.lit(1))).scalar()
    summary = tables["summary"].select(F.struct("*").alias("s")).scalar()
    return counts.withColumn("_s", summary).select("*", "_s.*").drop("_s").withColumn("n_sample", sample)


@query
def streaming_scoring_job(spark, sf_dir):
    """The turns as files of a folder, two for each micro-batch, scored by the saved pipeline."""
    source = table(spark, sf_dir, "conversations")
    folder, output = stage_path(spark, "arriving"), stage_path(spark, "scored-stream")
    source.repartition(5, "conv_id").write.parquet(folder)
    model, checkpoint = _saved_model(spark, sf_dir), stage_path(spark, "job-checkpoint")
    score_folder(spark, folder, source.schema, model, output, checkpoint, "text", files_per_trigger=2).awaitTermination()
    return _flat_answers(spark.read.parquet(output))


@query
def notebook_comparison(spark, sf_dir):
    """Preprocess, split 80/20 by class, damped TF-IDF of 10,000 terms, naive Bayes: metrics of the held-out part."""
    train, test = _notebook_parts(spark, sf_dir)
    return rounded(V.classification_report(_notebook_scores(M.fit_naive_bayes(train), test)))


@query
def notebook_comparison_logistic(spark, sf_dir):
    """The same with balanced logistic regression."""
    train, test = _notebook_parts(spark, sf_dir)
    fitted = M.fit_logistic(M.balanced_weights(train))
    return rounded(V.classification_report(_notebook_scores(fitted, test)))


def _notebook_parts(spark, sf_dir):
    texts = labelled_reviews(spark, sf_dir).select("review_id", "sentiment", TX.preprocess("review_body").alias("text"))
    rows = stage(G.stratified_split(M.training_rows(texts)), "notebook")
    train, test = (rows.filter(F.col("split") == s) for s in ("train", "test"))
    model = X.fit_features(train, "text", 2, X.LEGACY_MIN_DF, X.LEGACY_MAX_FEATURES)
    return [X.sublinear_features(part, model, "text") for part in (train, test)]


def _notebook_scores(fitted, test):
    return fitted.transform(test).select("sentiment", L.label_name(M.PREDICTION).alias("predicted_sentiment"))


# Evaluation


@query
def confusion_matrix(spark, sf_dir):
    return V.confusion_matrix(scored_reviews(spark, sf_dir))


@query
def class_metrics(spark, sf_dir):
    return rounded(V.class_metrics(scored_reviews(spark, sf_dir)))


@query
def overall_metrics(spark, sf_dir):
    return rounded(V.overall_metrics(scored_reviews(spark, sf_dir)))


@query
def classification_report(spark, sf_dir):
    return rounded(V.classification_report(scored_reviews(spark, sf_dir)))


@query
def domain_metrics(spark, sf_dir):
    return rounded(V.domain_metrics(scored_reviews(spark, sf_dir)))


@query
def baseline_comparison(spark, sf_dir):
    return rounded(V.baseline_comparison(V.metric_values(scored_reviews(spark, sf_dir))))


def _with_probabilities(df, shift):
    p = (F.col("review_id") % 100 + 1) / 202.0
    return df.withColumns(
        {"prob_Negative": p, "prob_Neutral": p, "prob_Positive": 1 - 2 * p + shift}
    )


def _parity_sides(spark, sf_dir):
    """Two scored tables that differ in some labels, probabilities and rows."""
    scored = scored_reviews(spark, sf_dir)
    a = _with_probabilities(scored.filter("language != 'es'"), 0.0)
    b = _with_probabilities(scored.filter("language != 'de'"), F.when(F.col("review_id") % 7 == 0, 0.01).otherwise(0.0))
    b = b.withColumn("predicted_sentiment", F.when(F.col("review_id") % 23 == 0, "Neutral").otherwise(F.col("predicted_sentiment")))
    return a, b.withColumn("prob_Neutral", F.when(F.col("review_id") % 31 != 0, F.col("prob_Neutral")))


@query
def parity_check(spark, sf_dir):
    return rounded(V.parity_check(*_parity_sides(spark, sf_dir), "review_id"))


@query
def text_overlap(spark, sf_dir):
    """Turns and benchmark items whose text is a review body or title."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("item"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("item"), "text")
    titles = sample_reviews(spark, sf_dir).select(
        F.concat(F.lit("r"), "review_id").alias("item"),
        F.concat(F.lit(" "), F.coalesce("review_title", F.lit("")), F.lit("\n")).alias("text"),
    )
    return V.text_overlap(G.union_splits(turns, items, titles), sample_reviews(spark, sf_dir), "text")


@query
def unseen_benchmark(spark, sf_dir):
    scored = scored_reviews(spark, sf_dir).select(
        F.col("language").alias("domain"),
        F.col("sentiment").alias("expected_sentiment"),
        "predicted_sentiment",
        (F.col("review_id") % 29 == 0).alias("is_qualitative"),
    )
    return rounded(V.unseen_benchmark(scored))


@query
def probability_columns(spark, sf_dir):
    model, _ = _model(spark, sf_dir)
    texts = table(spark, sf_dir, "benchmark").withColumn(X.TEXT, F.col("text"))
    scored = V.probability_columns(model.transform(texts), M.PROBABILITY)
    return rounded(scored.select("item_id", *[f"prob_{c}" for c in LABELS]))


@query
def sentiment_distribution(spark, sf_dir):
    return V.sentiment_distribution(labelled_reviews(spark, sf_dir))


@query
def category_accuracy(spark, sf_dir):
    scored = scored_reviews(spark, sf_dir)
    return rounded(V.category_accuracy(scored, "product_category", actual="sentiment"))


@query
def keyword_classes(spark, sf_dir):
    texts = X.with_terms(prepared(spark, sf_dir).select("sentiment", "review_body"), "review_body", 1)
    return V.keyword_by_class(texts, KEYWORDS, "terms")


@query
def feature_contributions(spark, sf_dir):
    model, _ = _model(spark, sf_dir)
    return rounded(M.feature_contributions(table(spark, sf_dir, "benchmark"), model, "text", "item_id"))


@query
def unknown_terms(spark, sf_dir):
    train, val, _ = _splits(spark, sf_dir)
    texts = train.unionByName(val).select(M.model_text("B").alias("text"))
    model = X.fit_features(texts, "text", 2)
    return M.unknown_terms(table(spark, sf_dir, "benchmark"), model, "text", "item_id")


# Parts, batches and streams that are merged


@query
def merged_length_stats(spark, sf_dir):
    """Statistics from sketches of each language, merged; quartiles as whether their rank is within the stated error."""
    reviews = sample_reviews(spark, sf_dir)
    sketches = stage(K.length_sketches(reviews, "language"), "length-sketches")
    stats = stage(K.merge_length_stats(sketches), "merged-stats")
    errors = K.rank_errors(reviews, stats)
    close = [(F.col(f"{q}_error") <= K.QUANTILE_ERROR).alias(f"{q}_close") for q in ("median", "q25", "q75")]
    return rounded(stats.drop("median", "q25", "q75").join(errors.select("measure", *close), "measure"))


@query
def merged_distinct_ids(spark, sf_dir):
    """Exact counts, and whether those of the merged sketches are within three standard errors."""
    reviews = sample_reviews(spark, sf_dir)
    sketches = stage(K.distinct_sketches(reviews, "language"), "distinct-sketches")
    near = K.merge_distinct_counts(sketches).select(F.struct("*").alias("n")).scalar()
    exact = A.distinct_counts(reviews)
    close = [(F.abs(near[c] - F.col(c)) <= 3 * K.DISTINCT_ERROR * F.col(c)).alias(f"{c}_close") for c in exact.columns]
    return exact.select("*", *close)


@query
def domain_intervals(spark, sf_dir):
    return rounded(V.domain_intervals(scored_reviews(spark, sf_dir), "review_id"))


@query
def parity_mismatches(spark, sf_dir):
    """The rows of ``parity_check`` that do not match, found through the buckets that differ."""
    return rounded(V.parity_by_buckets(*_parity_sides(spark, sf_dir), "review_id", buckets=1024).filter("NOT match"))


@query
def keyword_table_classes(spark, sf_dir):
    """Words and phrases of up to three words of the benchmark as keywords over all reviews."""
    items = X.with_terms(table(spark, sf_dir, "benchmark"), "text", 3)
    keywords = items.select(F.explode("terms").alias("keyword"))
    texts = prepared(spark, sf_dir).select("sentiment", X.term_tokens("review_body").alias("words"))
    return V.keyword_table_by_class(texts, keywords, "words")


def _cleaned_in_batches(spark, sf_dir):
    """The reviews of one star, then of two and so on; the changes of each batch, and the log."""
    reviews = sample_reviews(spark, sf_dir)
    log = I.BodyLog(spark, stage_path(spark, "body-log"))
    parts = [log.add(reviews.filter(F.col("stars") == i + 1), i).withColumn("batch", F.lit(i)) for i in range(5)]
    return G.union_splits(*parts), log


@query
def incremental_changes(spark, sf_dir):
    return _cleaned_in_batches(spark, sf_dir)[0]


@query
def incremental_clean_ids(spark, sf_dir):
    """All batches together keep what one cleaning keeps, also when the log is compacted."""
    _, log = _cleaned_in_batches(spark, sf_dir)
    return log.compact(stage_path(spark, "compact-log")).kept()


def _timed_turns(spark, sf_dir):
    """Scored turns with a time: conversations begin seven minutes apart, turns half a minute."""
    c, t = F.col("conv_id"), F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        F.timestamp_seconds(1_700_000_000 + c * 420 + t * 30).alias("time"),
        L.star_sentiment((1 + (c * 3 + t) % 5).cast("int")).alias("predicted_sentiment"),
        "text",
    )


#: Turns of a span of time that one file of the stream holds, as long as there are fewer files than shuffle partitions.
ROWS_PER_FILE = 2_000


def _arriving(spark, turns, parts, order):
    """The turns as a stream of files: equal spans of time in the given order, each one micro-batch.

    Each span is written by several tasks and read by several. The stream takes the same number of files a
    micro-batch, so empty files fill up a span with fewer.
    """
    folder = stage_path(spark, "arriving-turns")
    place = F.col("time").cast("long")
    bounds = turns.agg(F.min(place).alias("low"), (F.max(place) + 1).alias("high"), F.count("time").alias("rows")).first()
    number = F.floor((place - bounds.low) * parts / (bounds.high - bounds.low))
    files = max(1, min(bounds.rows // parts // ROWS_PER_FILE, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    for done, i in enumerate(order, 1):
        turns.filter(number == i).repartition(files).write.mode("append").parquet(folder)
        written = len(spark.read.schema(turns.schema).parquet(folder).inputFiles())
        for _ in range(done * files - written):
            spark.createDataFrame([], turns.schema).write.mode("append").parquet(folder)
    return spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _epochs(df):
    return df.withColumns({c: F.unix_timestamp(c) for c in ("window_start", "window_end")})


@query
def windowed_summary(spark, sf_dir):
    """Files in the order of time, windows of six hours, an hour's delay."""
    stream = _arriving(spark, _timed_turns(spark, sf_dir), 4, range(4))
    path = stage_path(spark, "window-summaries")
    W.stream_summary(stream, path, stage_path(spark, "summary-checkpoint"), "time", "6 hours").awaitTermination()
    return _epochs(W.window_summaries(spark, path))


@query
def windowed_top_words(spark, sf_dir):
    """Files in another order than time, with a delay that covers it."""
    stream = _arriving(spark, _timed_turns(spark, sf_dir), 4, (2, 0, 3, 1)).withColumn("processed_text", TX.preprocess("text"))
    path = stage_path(spark, "window-words")
    W.stream_words(stream, path, stage_path(spark, "words-checkpoint"), "time", "2 days", "3650 days").awaitTermination()
    return _epochs(W.window_top_words(spark, path))
