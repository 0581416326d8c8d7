"""Classification metrics.

A scored table is reduced once to counts of (actual, predicted) pairs, at most
a dozen rows per group; every metric is arithmetic on those.
"""

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.text import normalize_join_text, text_digest
from reviewloom.operators.audit import value_counts
from reviewloom.schema import LABELS
from reviewloom.session import stage

ACTUAL, PREDICTED = "sentiment", "predicted_sentiment"

# Metrics of the earlier one-domain model, the published baseline.
LEGACY_BASELINE = {
    "accuracy": 0.9162,
    "macro_precision": 0.5484,
    "macro_recall": 0.5897,
    "macro_f1": 0.5657,
    "weighted_f1": 0.9133,
    "f1_Negative": 0.6974,
    "f1_Neutral": 0.0408,
    "f1_Positive": 0.9590,
}

UNSTABLE_BELOW = 100

# Buckets of keys whose digests are compared first.
BUCKETS = 4096

# Bootstrap: replicates, and the width of an interval above which a category is unstable.
REPLICATES, WIDEST_STABLE = 100, 0.10


def _poisson_edges(limit=2**32):
    """Where a uniform number below ``limit`` passes from k to k + 1 draws, with mean 1."""
    edges, term, total = [], math.exp(-1), 0.0
    for k in range(1, 12):
        total += term
        edges.append(round(total * limit))
        term /= k
    return edges


POISSON_EDGES = _poisson_edges()


def pair_counts(scored: DataFrame, actual=ACTUAL, predicted=PREDICTED, by=()) -> DataFrame:
    return scored.groupBy(*by, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _label_rows(pairs, by=(), always=()):
    """Per label: support, predictions, hits, and precision, recall, F1.

    A label is listed when it occurs as actual or predicted; those in
    ``always`` are listed with zeros otherwise.
    """
    n, zero = F.col("n"), F.lit(0).cast("long")
    hit = F.col("actual") == F.col("predicted")

    def row(label, support, predicted, hits):
        return F.struct(
            label.alias("label"), support.alias("support"), predicted.alias("predicted"), hits.alias("hits")
        )

    rows = [
        row(F.col("actual"), n, zero, F.when(hit, n).otherwise(zero)),
        row(F.col("predicted"), zero, n, zero),
        *[row(F.lit(label), zero, zero, zero) for label in always],
    ]
    f1_parts = F.col("predicted") + F.col("support")
    return (
        pairs.select(*by, F.inline(F.array(*rows)))
        .filter(F.col("label").isNotNull())
        .groupBy(*by, "label")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
        .withColumn("precision", _ratio(F.col("hits"), F.col("predicted")))
        .withColumn("recall", _ratio(F.col("hits"), F.col("support")))
        .withColumn("f1", _ratio(2 * F.col("hits"), f1_parts))
    )


def confusion_matrix(scored: DataFrame, actual=ACTUAL, predicted=PREDICTED) -> DataFrame:
    """Rows actual, columns predicted; all fixed labels, zeros kept."""
    pairs = pair_counts(scored, actual, predicted)
    sums = [
        F.coalesce(F.sum(F.when((F.col("actual") == a) & (F.col("predicted") == p), F.col("n"))), F.lit(0)).alias(
            f"{a}_{p}"
        )
        for a in LABELS
        for p in LABELS
    ]
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("actual"), *[F.col(f"{a}_{p}").alias(f"predicted_{p}") for p in LABELS])
            for a in LABELS
        ]
    )
    return pairs.agg(*sums).select(F.inline(rows))


def class_metrics(scored: DataFrame, actual=ACTUAL, predicted=PREDICTED) -> DataFrame:
    """Precision, recall, F1 and support of the three fixed labels."""
    rows = _label_rows(pair_counts(scored, actual, predicted), always=LABELS)
    return rows.filter(F.col("label").isin(*LABELS)).select("label", "precision", "recall", "f1", "support")


def _averages(rows, by=()):
    """Accuracy, macro over the labels present, weighted by support."""

    def weighted(metric):
        return _ratio(F.sum(F.col(metric) * F.col("support")), F.sum("support"))

    present = rows.filter("support + predicted > 0")
    return present.groupBy(*by).agg(
        F.sum("support").alias("n"),
        _ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        weighted("precision").alias("weighted_precision"),
        weighted("recall").alias("weighted_recall"),
        weighted("f1").alias("weighted_f1"),
    )


def overall_metrics(scored: DataFrame, actual=ACTUAL, predicted=PREDICTED) -> DataFrame:
    return _averages(_label_rows(pair_counts(scored, actual, predicted)))


def classification_report(scored: DataFrame, actual=ACTUAL, predicted=PREDICTED) -> DataFrame:
    """Class rows, accuracy, macro and weighted averages as one long table."""
    rows = _label_rows(pair_counts(scored, actual, predicted), always=LABELS)
    classes = rows.filter(F.col("label").isin(*LABELS)).select(
        F.col("label").alias("row"), "precision", "recall", "f1", "support"
    )
    nothing = F.lit(None).cast("double")

    def line(name, p, r, f):
        return F.struct(
            F.lit(name).alias("row"), p.alias("precision"), r.alias("recall"), f.alias("f1"), F.col("n").alias("support")
        )

    c = F.col
    averages = _averages(rows).select(
        F.inline(
            F.array(
                line("accuracy", nothing, nothing, c("accuracy")),
                line("macro avg", c("macro_precision"), c("macro_recall"), c("macro_f1")),
                line("weighted avg", c("weighted_precision"), c("weighted_recall"), c("weighted_f1")),
            )
        )
    )
    return classes.unionByName(averages)


def domain_metrics(
    scored: DataFrame, by="product_category", min_n=UNSTABLE_BELOW, actual=ACTUAL, predicted=PREDICTED
) -> DataFrame:
    """Quality per category in one pass; categories under ``min_n`` rows flagged."""
    rows = _label_rows(pair_counts(scored, actual, predicted, [by]), [by])
    f1 = rows.groupBy(by).agg(
        *[F.coalesce(F.max(F.when(F.col("label") == c, F.col("f1"))), F.lit(0.0)).alias(f"f1_{c}") for c in LABELS]
    )
    return (
        _averages(rows, [by])
        .join(f1, by)
        .select(by, "n", "accuracy", *[f"f1_{c}" for c in LABELS], "macro_f1", (F.col("n") < min_n).alias("unstable"))
        .orderBy(F.desc("n"), by)
    )


def poisson_weight(key, replicate):
    """How often a row is drawn in a replicate of the bootstrap: Poisson(1) from a hash of key and replicate.

    A digest gives four uniform numbers of 32 bits, so four replicates share one.
    """
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.floor(replicate / 4).cast("string")))
    uniform = F.conv(F.substr(digest, replicate % 4 * 8 + 1, F.lit(8)), 16, 10).cast("long")
    return sum((uniform >= edge).cast("int") for edge in POISSON_EDGES)


def domain_intervals(
    scored: DataFrame,
    key: str,
    by="product_category",
    replicates=REPLICATES,
    level=0.95,
    widest=WIDEST_STABLE,
    actual=ACTUAL,
    predicted=PREDICTED,
) -> DataFrame:
    """Accuracy and macro F1 per category with bootstrap intervals; ``unstable``: an interval wider than ``widest``.

    One pass: each row counts in every replicate as often as a hash of its
    ``key`` says, so that a rerun draws the same. A task sends one count for
    each category, pair of labels and replicate, whatever its rows.
    """
    replicate = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")
    drawn = (
        scored.select(by, actual, predicted, F.col(key).alias("_key"), replicate)
        .withColumn("weight", poisson_weight(F.col("_key"), F.col("replicate")))
        .filter("weight > 0")
        .groupBy(by, "replicate", F.col(actual).alias("actual"), F.col(predicted).alias("predicted"))
        .agg(F.sum("weight").alias("n"))
    )
    each = _averages(_label_rows(drawn, [by, "replicate"]), [by, "replicate"])
    tail = (1 - level) / 2
    measures = ("accuracy", "macro_f1")
    spread = each.groupBy(by).agg(
        *[F.percentile(m, F.lit(share)).alias(f"{m}_{end}") for m in measures for end, share in (("low", tail), ("high", 1 - tail))]
    )
    wide = [F.col(f"{m}_high") - F.col(f"{m}_low") > widest for m in measures]
    point = _averages(_label_rows(pair_counts(scored, actual, predicted, [by]), [by]), [by]).select(by, "n", *measures)
    same = F.col(by).eqNullSafe(F.col("_by"))
    return point.join(spread.withColumnRenamed(by, "_by"), same, "left").select(
        by,
        "n",
        *[c for m in measures for c in (m, f"{m}_low", f"{m}_high")],
        F.coalesce(wide[0] | wide[1], F.lit(True)).alias("unstable"),
    )


def metric_values(scored: DataFrame, actual=ACTUAL, predicted=PREDICTED) -> DataFrame:
    """Overall metrics and the F1 of each class in long form (metric, value)."""
    rows = _label_rows(pair_counts(scored, actual, predicted), always=LABELS)
    overall = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1"]
    averages = _averages(rows).unpivot([], overall, "metric", "value")
    classes = rows.filter(F.col("label").isin(*LABELS)).select(
        F.concat(F.lit("f1_"), "label").alias("metric"), F.col("f1").alias("value")
    )
    return averages.unionByName(classes)


def baseline_comparison(values: DataFrame, baseline=None) -> DataFrame:
    """New against old value of each metric, and the difference."""
    baseline = LEGACY_BASELINE if baseline is None else baseline
    old = values.sparkSession.createDataFrame(list(baseline.items()), "metric string, baseline double")
    return values.join(old, "metric").select(
        "metric", "baseline", "value", (F.col("value") - F.col("baseline")).alias("delta")
    )


def parity_check(a: DataFrame, b: DataFrame, key: str, label=PREDICTED, tolerance=1e-9) -> DataFrame:
    """Two scored tables by id: same label, and probabilities within tolerance.

    ``missing_in`` names the table that lacks the row, so a row on one side
    only never counts as a match. A probability that is NULL on one side alone
    is no match either; NULL on both is. A repeated key is an error.
    """
    probabilities = [f"prob_{c}" for c in LABELS]

    def side(df, name):
        values = F.struct(F.col(label).alias("label"), *probabilities)
        rows = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max(values).alias("_v"))
        message = F.concat(F.lit(f"{key} occurs more than once: "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))
        once = F.when(F.col("_n") > 1, F.raise_error(message)).otherwise(F.lit(True))
        return rows.select(
            key,
            F.col("_v.label").alias(f"label_{name}"),
            *[F.col(f"_v.{p}").alias(f"{p}_{name}") for p in probabilities],
            once.alias(f"in_{name}"),
        )

    def near(p):
        a, b = F.col(f"{p}_a"), F.col(f"{p}_b")
        return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))

    gap = F.greatest(*[F.abs(F.col(f"{p}_a") - F.col(f"{p}_b")) for p in probabilities])
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    same = F.col("label_a").eqNullSafe(F.col("label_b"))
    for p in probabilities:
        same = same & near(p)
    return (
        side(a, "a")
        .join(side(b, "b"), key, "full_outer")
        .select(
            key,
            "label_a",
            "label_b",
            gap.alias("max_probability_gap"),
            F.when(F.col("in_a").isNull(), "a").when(F.col("in_b").isNull(), "b").alias("missing_in"),
            (both & same).alias("match"),
        )
    )


def bucket_digests(df: DataFrame, key: str, label=PREDICTED, buckets=BUCKETS) -> DataFrame:
    """Rows of each bucket of keys and digests of its contents that do not depend on order.

    A task sends one row for each bucket. Two sums of independent 64-bit hashes tell buckets apart.
    """
    values = [key, label, *[f"prob_{c}" for c in LABELS]]
    # a NULL must not be skipped by the hash, nor a value slip into the place of the next
    parts = F.struct(*[F.col(c).isNull().alias(f"no_{i}") for i, c in enumerate(values)], *values)
    hashes = [F.xxhash64(F.lit(seed), parts) for seed in (1, 2)]
    return df.groupBy(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(h.cast("decimal(20,0)")).alias(f"digest_{i}") for i, h in enumerate(hashes)],
    )


def differing_buckets(a: DataFrame, b: DataFrame, key: str, label=PREDICTED, buckets=BUCKETS) -> DataFrame:
    """The buckets of keys whose rows are not the same in both tables: at most ``buckets`` rows, staged."""
    left, right = (bucket_digests(df, key, label, buckets) for df in (a, b))
    columns = ("n", "digest_0", "digest_1")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns]
    joined = left.alias("a").join(right.alias("b"), "bucket", "full_outer")
    return stage(joined.filter(~(same[0] & same[1] & same[2])).select("bucket"), "differing-buckets")


def parity_by_buckets(a: DataFrame, b: DataFrame, key: str, label=PREDICTED, tolerance=1e-9, buckets=BUCKETS) -> DataFrame:
    """``parity_check`` of the buckets whose digests differ; no row of the others is shuffled.

    All rows that do not match are in it, and the matching ones of their
    buckets. Repeated keys are an error only there: where both tables repeat
    the same rows, buckets are equal.
    """
    differing = differing_buckets(a, b, key, label, buckets)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets))
    sides = [df.join(F.broadcast(differing), bucket == differing.bucket, "left_semi") for df in (a, b)]
    return parity_check(*sides, key, label, tolerance)


def text_overlap(
    evaluation: DataFrame, train: DataFrame, text: str, body="review_body", title="review_title"
) -> DataFrame:
    """Evaluation rows whose text equals a training body or title.

    Outer whitespace and case do not matter. The training table is scanned
    against the evaluation keys, which Spark broadcasts when they are small;
    it shuffles digests only when they are not.
    """
    keyed = evaluation.withColumn("_key", text_digest(normalize_join_text(text)))
    sides = F.array(text_digest(normalize_join_text(body)), text_digest(normalize_join_text(title)))
    seen = train.select(F.explode(F.array_distinct(sides)).alias("_key"))
    hits = seen.join(keyed.select("_key").distinct(), "_key").distinct()
    return keyed.join(hits, "_key", "left_semi").drop("_key")


def assert_no_overlap(evaluation: DataFrame, train: DataFrame, text: str, **columns) -> DataFrame:
    if not text_overlap(evaluation, train, text, **columns).isEmpty():
        raise ValueError("evaluation texts occur in the training table")
    return evaluation


def unseen_benchmark(
    scored: DataFrame, domain="domain", actual="expected_sentiment", predicted=PREDICTED, excluded="is_qualitative"
) -> DataFrame:
    """Accuracy and macro F1 of the unseen set, overall (``all``) and per domain."""
    if excluded in scored.columns:
        scored = scored.filter(~F.coalesce(F.col(excluded), F.lit(False)))
    pairs = pair_counts(scored, actual, predicted, [domain])
    columns = ["n", "accuracy", "macro_f1"]
    overall = _averages(_label_rows(pairs)).select(F.lit("all").alias(domain), *columns)
    return overall.unionByName(_averages(_label_rows(pairs, [domain]), [domain]).select(domain, *columns))


def probability_columns(scored: DataFrame, probability="probability") -> DataFrame:
    """One ``prob_<class>`` column per label from the probability vector."""
    p = vector_to_array(probability)
    return scored.withColumns({f"prob_{label}": p[i] for i, label in enumerate(LABELS)})


def sentiment_distribution(df: DataFrame, sentiment=ACTUAL) -> DataFrame:
    return value_counts(df, sentiment)


def category_accuracy(scored: DataFrame, by="category", actual="expected_sentiment", predicted=PREDICTED) -> DataFrame:
    """Rows, correct rows and their share per test category."""
    correct = F.col(predicted).eqNullSafe(F.col(actual))
    return scored.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(correct).alias("n_correct"),
        F.avg(correct.cast("double")).alias("accuracy"),
    )


def keyword_by_class(df: DataFrame, words, terms: str, label=ACTUAL) -> DataFrame:
    """Per distinct keyword: rows that contain it, in all and by class; 0 for unseen words.

    ``terms`` is a token list column. Keywords are cut out of each list before
    the shuffle, so only hits move.
    """
    words = list(dict.fromkeys(words))
    keywords = F.lit(words)
    found = df.select(label, F.explode(F.array_intersect(terms, keywords)).alias("word"))
    listed = df.sparkSession.createDataFrame([(w,) for w in words], "word string").withColumn(
        label, F.lit(None).cast("string")
    )
    sums = [F.count_if(F.col(label) == c).alias(f"n_{c}") for c in LABELS]
    return found.select("word", label).unionByName(listed).groupBy("word").agg(
        (F.count(F.lit(1)) - 1).alias("n_total"), *sums
    )


def keyword_table_by_class(df: DataFrame, keywords: DataFrame, words: str, label=ACTUAL, keyword="keyword") -> DataFrame:
    """``keyword_by_class`` for a table of keywords, however many, with phrases among them.

    ``words`` is a token list column; a keyword is its words joined by single
    spaces. Rows are cut into n-grams of the lengths that keywords have, and
    counted once for each n-gram they hold. Where the keywords are small enough
    for Spark to broadcast, it drops all other n-grams before they are counted;
    else counts meet keywords in a shuffle, in which a frequent n-gram is one
    row a task. Repeated keywords count once; NULL and empty ones are none.
    """
    listed = keywords.select(F.col(keyword).alias("word")).filter("word > ''").distinct()
    lengths = [r[0] for r in listed.select(F.size(F.split("word", " ")).alias("n")).distinct().orderBy("n").collect()]
    grams = F.array_distinct(F.concat(F.array().cast("array<string>"), *[_runs(words, n) for n in lengths]))
    counts = (
        df.select(F.col(label).alias("_label"), F.explode(grams).alias("word"))
        .groupBy("_label", "word")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(listed, "word", "left_semi")
    )
    n = F.col("n")
    sums = [F.coalesce(F.sum(F.when(F.col("_label") == c, n)), F.lit(0)).alias(f"n_{c}") for c in LABELS]
    per_word = counts.groupBy("word").agg(F.sum("n").alias("n_total"), *sums)
    columns = ["n_total", *[f"n_{c}" for c in LABELS]]
    return listed.join(per_word, "word", "left").select("word", *[F.coalesce(c, F.lit(0)).alias(c) for c in columns])


def _runs(words, n):
    """All runs of ``n`` words of a list, joined by spaces.

    Single words stay as they are, and short runs take their words by place: a slice a run takes several times as long.
    """
    if n == 1:
        return F.coalesce(words, F.array().cast("array<string>"))
    if n <= 8:
        run = lambda word, i: F.concat_ws(" ", word, *[F.get(words, i + k) for k in range(1, n)])
    else:
        run = lambda word, i: F.array_join(F.slice(words, i + 1, n), " ")
    runs = F.when(F.size(words) >= n, F.transform(F.slice(words, F.lit(1), F.size(words) - (n - 1)), run))
    return F.coalesce(runs, F.array().cast("array<string>"))
