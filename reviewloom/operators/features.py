"""Terms, vocabulary and TF-IDF features.

The vocabulary is one shuffle of counts per block of rows; it is the only thing that
passes the driver, and its size is a parameter. Everything after that works
row by row on sparse vectors: weighting and normalising a document needs no
shuffle.
"""

import math

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.operators import term_counts
from reviewloom.session import batches_of, stage, stage_path

TEXT, WORDS, TERMS, TF, WEIGHTED, FEATURES = (
    f"_model_{name}" for name in ("text", "words", "terms", "tf", "weighted", "features")
)

MAX_FEATURES, MIN_DF = 50_000, 2
LEGACY_MAX_FEATURES, LEGACY_MIN_DF = 10_000, 1


def _words_sql(text):
    return f"regexp_extract_all(lower(coalesce({text}, '')), r'[\\p{{L}}\\p{{N}}_]{{2,}}', 0)"


def _ngrams_sql(words, n_max):
    parts = [words]
    for n in range(2, n_max + 1):
        grams = ", ".join(f"{words}[i + {k}]" for k in range(n))
        parts.append(
            f"CASE WHEN size({words}) >= {n} THEN transform(sequence(0, size({words}) - {n}), "
            f"i -> concat_ws(' ', {grams})) ELSE array() END"
        )
    return f"concat({', '.join(parts)})"


def term_tokens(text: str):
    """Lower-case words of two or more letters, digits or underscores."""
    return F.expr(_words_sql(text))


def ngrams(words: str, n_max: int):
    """All runs of 1 to ``n_max`` words of a token list, joined by spaces."""
    return F.expr(_ngrams_sql(words, n_max))


def _term_stages(n_max):
    return [
        SQLTransformer(statement=f"SELECT *, {_words_sql(TEXT)} AS {WORDS} FROM __THIS__"),
        SQLTransformer(statement=f"SELECT *, {_ngrams_sql(WORDS, n_max)} AS {TERMS} FROM __THIS__"),
    ]


def with_terms(df: DataFrame, text: str, n_max=1, out="terms") -> DataFrame:
    return df.withColumn("_words", term_tokens(text)).withColumn(out, ngrams("_words", n_max)).drop("_words")


def partial_counts(df: DataFrame, terms: str, n_max=1) -> DataFrame:
    """(term, df, cf): rows with the term and its occurrences, each in a block of rows; to be summed.

    ``n_max``: runs of up to so many elements of the list, then words without spaces, are terms too, joined
    by spaces. Terms are counted a block at a time, so that Spark sees one once a block and not once an occurrence.
    """
    # words without spaces go to Python as one text
    sent = F.col(terms) if n_max == 1 else F.nullif(F.array_join(terms, " "), F.lit(""))
    return df.select(sent).mapInArrow(term_counts.count_in_blocks(n_max), "term string, df bigint, cf bigint")


def frequent_cells(df: DataFrame, terms: str, min_df: int, cells: int, n_max=1) -> DataFrame:
    """(word, mask): the bits of the hash cells in which ``min_df`` documents or more have a term; staged.

    A row of a count-min sketch: the count of a cell is at least that of each
    of its terms, so that no frequent term is outside. At most ``cells`` / 64 rows.
    """
    cell = F.pmod(F.xxhash64("term"), F.lit(cells)).alias("cell")
    counts = partial_counts(df, terms, n_max).groupBy(cell).agg(F.sum("df").alias("n")).filter(F.col("n") >= min_df)
    bit = F.expr("shiftleft(1L, CAST(cell % 64 AS INT))")
    return stage(counts.groupBy(F.floor(F.col("cell") / 64).alias("word")).agg(F.bit_or(bit).alias("mask")), "frequent-cells")


def _in_frequent_cells(rows: DataFrame, term: str, frequent: DataFrame, cells: int) -> DataFrame:
    """The rows whose term is in a frequent cell; the masks, of bounded size, go to every task."""
    cell = F.pmod(F.xxhash64(term), F.lit(cells))
    rows = rows.withColumns({"word": F.floor(cell / 64), "_bit": (cell % 64).cast("int")})
    kept = rows.join(F.broadcast(frequent), "word").filter(F.getbit("mask", F.col("_bit")) == 1)
    return kept.drop("word", "_bit", "mask")


def vocabulary(
    df: DataFrame, terms="terms", min_df=MIN_DF, max_features=MAX_FEATURES, prefilter_cells=None, n_max=1
) -> DataFrame:
    """The most frequent terms: (term, df, cf), ties by term.

    ``n_max`` above 1 counts the runs of the list's words as well, without a list of them.

    With ``prefilter_cells`` the documents are read twice: first to count hash
    cells, so that terms in cells under ``min_df`` are not shuffled in the
    second. That pays where rare terms are many and the network is the limit;
    a cell should have a few terms at most.

    Terms are counted in blocks of rows, and one aggregation with a partial
    step sums the counts, so documents are never regrouped. The lowest count that
    can still be in is taken from a histogram of the counts, so that the final
    order holds little more than ``max_features`` rows.
    """
    parts = partial_counts(df, terms, n_max)
    if prefilter_cells:
        frequent = frequent_cells(df, terms, min_df, prefilter_cells, n_max)
        parts = _in_frequent_cells(parts, "term", frequent, prefilter_cells)
    counts = parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter(F.col("df") >= min_df)
    if not max_features:
        return counts
    running = Window.partitionBy().orderBy(F.desc("cf"))
    lowest = (
        counts.groupBy("cf")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("higher", F.sum("n").over(running) - F.col("n"))
        .filter(F.col("higher") < max_features)
        .agg(F.min("cf"))
        .scalar()
    )
    return counts.filter(F.col("cf") >= lowest).orderBy(F.desc("cf"), "term").limit(max_features)


def idf(terms: DataFrame, n_documents) -> DataFrame:
    """Smoothed inverse document frequency, ln((1 + n) / (1 + df)) + 1, and the
    alphabetical index of each vocabulary term.

    ``n_documents``: a number, or a scalar subquery.
    """
    n = n_documents if not isinstance(n_documents, int) else F.lit(n_documents)
    return terms.withColumn("idf", F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1).withColumn(
        "term_index", F.row_number().over(Window.partitionBy().orderBy("term")).cast("long") - 1
    )


def fit_features(
    train: DataFrame, text: str, n_max=2, min_df=MIN_DF, max_features=MAX_FEATURES, staged=False
) -> PipelineModel:
    """Fit vocabulary and weights on ``train``; apply with ``transform_features``.

    The stages: words, terms, counts, times idf, scaled to length 1. Terms are
    numbered alphabetically. The texts are staged once as a narrow table, unless ``train``
    is ``staged`` already, and the vocabulary and the number of documents are read from there. The driver holds
    the vocabulary, so ``max_features`` has to bound it.
    """
    if not max_features:
        raise ValueError("max_features has to bound the vocabulary")
    stages = _term_stages(n_max)
    texts = train.select(F.col(text).alias(TEXT))
    texts = texts if staged else stage(texts, "texts")
    with batches_of(texts.sparkSession, term_counts.SENT_AT_ONCE):
        rows = vocabulary(PipelineModel(stages[:1]).transform(texts), WORDS, min_df, max_features, n_max=n_max).collect()
    if not rows:
        raise ValueError("no term occurs in enough documents")
    n = texts.count()
    idf_of = {r.term: math.log((1 + n) / (1 + r.df)) + 1 for r in rows}
    counter = CountVectorizerModel.from_vocabulary(sorted(idf_of), inputCol=TERMS, outputCol=TF)
    weights = Vectors.dense([idf_of[term] for term in counter.vocabulary])
    return PipelineModel(
        stages
        + [
            counter,
            ElementwiseProduct(scalingVec=weights, inputCol=TF, outputCol=WEIGHTED),
            Normalizer(p=2.0, inputCol=WEIGHTED, outputCol=FEATURES),
        ]
    )


def transform_features(model: PipelineModel, df: DataFrame, text: str) -> DataFrame:
    """Add the TF-IDF vector column to ``df``."""
    return (
        model.transform(df.withColumn(TEXT, F.col(text)))
        .drop(TEXT, WORDS, TERMS, WEIGHTED)
    )


def feature_terms(model: PipelineModel) -> list[str]:
    return next(s for s in model.stages if isinstance(s, CountVectorizerModel)).vocabulary


def _vocabulary_frame(spark, model):
    scale = next(s for s in model.stages if isinstance(s, ElementwiseProduct)).getScalingVec()
    rows = [(i, term, float(scale[i])) for i, term in enumerate(feature_terms(model))]
    return spark.createDataFrame(rows, "term_index int, term string, idf double")


def sparse_parts(vector):
    """Struct with ``indices`` and ``values`` of a sparse vector column."""
    return F.unwrap_udt(vector)


def _with_damped(features):
    """Add ``_indices`` and ``_values``: (1 + ln(count)) * idf of each entry.

    Counts and weighted counts share their indices, and their ratio is the idf.
    """
    damped = F.zip_with(
        sparse_parts(TF)["values"], sparse_parts(WEIGHTED)["values"], lambda tf, w: (1 + F.log(tf)) * w / tf
    )
    return features.withColumn("_indices", sparse_parts(TF)["indices"]).withColumn("_values", damped)


def tfidf_table(df: DataFrame, model: PipelineModel, text: str, *keep: str, sublinear=False) -> DataFrame:
    """Long form (kept columns, term, weight) of the TF-IDF vectors.

    ``keep`` names the id and whatever else each entry shall carry, a label for
    one, so that it need not be joined to the many entries later. ``sublinear``
    damps counts to 1 + ln(count). The vocabulary joined for the term names has
    at most ``max_features`` rows.
    """
    features = model.transform(df.select(*keep, F.col(text).alias(TEXT)))
    if sublinear:
        square = F.aggregate("_values", F.lit(0.0), lambda a, x: a + x * x)
        parts = _with_damped(features).withColumn("_length", F.sqrt(square))
    else:
        vector = sparse_parts(FEATURES)
        parts = features.select(
            *keep, vector["indices"].alias("_indices"), vector["values"].alias("_values"), F.lit(1.0).alias("_length")
        )
    entries = parts.select(
        *keep, "_length", F.inline(F.arrays_zip(F.col("_indices").alias("i"), F.col("_values").alias("w")))
    )
    terms = F.broadcast(_vocabulary_frame(df.sparkSession, model))
    return entries.join(terms, F.col("i") == F.col("term_index")).select(
        *keep, "term", (F.col("w") / F.col("_length")).alias("weight")
    )


def sublinear_features(df: DataFrame, model: PipelineModel, text: str) -> DataFrame:
    """Add TF-IDF vectors with damped counts, as the one-domain models used.

    No built-in stage takes the logarithm of a vector, so index and value
    lists are staged in the layout of a vector, read back as vectors, and
    scaled to length 1.
    """
    parts = F.struct(
        F.lit(0).cast("byte").alias("type"),
        F.lit(len(feature_terms(model))).alias("size"),
        F.col("_indices").alias("indices"),
        F.col("_values").alias("values"),
    )
    path = stage_path(df.sparkSession, "sublinear")
    damped = _with_damped(model.transform(df.withColumn(TEXT, F.col(text))))
    damped.select(*df.columns, parts.alias(WEIGHTED)).write.parquet(path)
    schema = T.StructType([*df.schema.fields, T.StructField(WEIGHTED, VectorUDT())])
    vectors = df.sparkSession.read.schema(schema).parquet(path)
    return Normalizer(p=2.0, inputCol=WEIGHTED, outputCol=FEATURES).transform(vectors).drop(WEIGHTED)


def feature_stats(features: DataFrame, model: PipelineModel, vector=FEATURES) -> DataFrame:
    """Add the number of nonzero features per row and the vocabulary size."""
    return features.withColumns(
        {
            "num_nonzero_features": F.size(sparse_parts(vector)["indices"]).cast("long"),
            "vocabulary_size": F.lit(len(feature_terms(model))).cast("long"),
        }
    )
