import pytest
from pyspark.sql import functions as F

from reviewloom.operators import features as X
from reviewloom.operators import metrics as V
from reviewloom.operators import models as M
from reviewloom.operators import scoring as R
from reviewloom.schema import LABELS, REVIEW_SCHEMA
from reviewloom.sources.reviews import detect_text_column, read_reviews, validate_input
from reviewloom.sources.tables import write_report, write_table
from reviewloom.streaming.scoring import score_stream

# The published confusion matrix: rows actual, columns predicted.
MATRIX = [[9429, 2233, 318], [1516, 3564, 907], [405, 1619, 9913]]


@pytest.fixture(scope="module")
def published(spark):
    cells = [(a, p, MATRIX[i][j]) for i, a in enumerate(LABELS) for j, p in enumerate(LABELS)]
    df = spark.createDataFrame(cells, "sentiment string, predicted_sentiment string, n int")
    return df.select("sentiment", "predicted_sentiment", F.explode(F.sequence(F.lit(1), "n"))).drop("col")


def test_published_metrics(published):
    got = {r.metric: round(r.value, 4) for r in V.metric_values(published).collect()}
    assert got == {
        "accuracy": 0.7660, "macro_precision": 0.7338, "macro_recall": 0.7376, "macro_f1": 0.7331, "weighted_f1": 0.7733,
        "f1_Negative": 0.8083, "f1_Neutral": 0.5318, "f1_Positive": 0.8592,
    }
    matrix = {r.actual: [r[f"predicted_{p}"] for p in LABELS] for r in V.confusion_matrix(published).collect()}
    assert [matrix[c] for c in LABELS] == MATRIX
    report = {r.row: r for r in V.classification_report(published).collect()}
    assert round(report["Negative"].precision, 4) == 0.8307 and round(report["Neutral"].recall, 4) == 0.5953
    assert report["Positive"].support == 11937 and round(report["weighted avg"].precision, 4) == 0.7843
    delta = {r.metric: r.delta for r in V.baseline_comparison(V.metric_values(published)).collect()}
    assert delta["macro_f1"] == pytest.approx(0.7331 - 0.5657, abs=1e-4) and len(delta) == 8


def test_macro_counts_only_labels_that_occur(spark):
    df = spark.createDataFrame([("Positive", "Positive"), ("Positive", "Negative")], "sentiment string, predicted_sentiment string")
    overall = V.overall_metrics(df).first()
    assert overall.macro_f1 == pytest.approx((2 / 3 + 0) / 2) and overall.accuracy == 0.5
    classes = {r.label: r for r in V.class_metrics(df).collect()}
    assert set(classes) == set(LABELS) and classes["Neutral"].f1 == 0 and classes["Neutral"].support == 0
    assert V.confusion_matrix(df.limit(0)).count() == 3


def test_domain_metrics_flag_small_categories(spark):
    rows = [("a", "Positive", "Positive")] * 100 + [("b", "Negative", "Neutral")] * 99
    df = spark.createDataFrame(rows, "product_category string, sentiment string, predicted_sentiment string")
    a, b = V.domain_metrics(df).collect()
    assert (a.product_category, a.n, a.unstable, a.macro_f1) == ("a", 100, False, 1.0)
    assert (b.product_category, b.n, b.unstable, b.macro_f1, b.f1_Positive) == ("b", 99, True, 0.0, 0.0)


def test_unseen_benchmark_leaves_out_qualitative_rows(spark):
    rows = [("home", "Positive", "Positive", False), ("home", "Neutral", "Neutral", None), ("wild", "Positive", "Negative", True)]
    df = spark.createDataFrame(
        rows, "domain string, expected_sentiment string, predicted_sentiment string, is_qualitative boolean"
    )
    got = {r.domain: (r.n, r.accuracy) for r in V.unseen_benchmark(df).collect()}
    assert got == {"all": (2, 1.0), "home": (2, 1.0)}


def test_parity_sees_labels_gaps_and_missing_rows(spark):
    schema = "id int, predicted_sentiment string, prob_Negative double, prob_Neutral double, prob_Positive double"
    a = spark.createDataFrame([(1, "Positive", 0.1, 0.1, 0.8), (2, "Positive", 0.1, 0.1, 0.8), (3, "Neutral", 0.0, 1.0, 0.0)], schema)
    b = spark.createDataFrame([(1, "Positive", 0.1, 0.1, 0.8), (2, "Positive", 0.2, 0.1, 0.7), (4, "Neutral", 0.0, 1.0, 0.0)], schema)
    got = {r.id: (r.match, r.missing_in) for r in V.parity_check(a, b, "id").collect()}
    assert got == {1: (True, None), 2: (False, None), 3: (False, "b"), 4: (False, "a")}
    assert V.parity_check(a, b, "id", tolerance=0.11).filter("match").count() == 2


def test_text_overlap_ignores_case_and_outer_space(spark):
    train = spark.createDataFrame([("Great  Phone", None), ("other", " My Title\n"), ("", None)], "review_body string, review_title string")
    unseen = spark.createDataFrame([(1, " great  phone"), (2, "MY TITLE"), (3, "great phone"), (4, "new")], "id int, review_text string")
    assert sorted(r.id for r in V.text_overlap(unseen, train, "review_text").collect()) == [1, 2]
    with pytest.raises(ValueError, match="occur"):
        V.assert_no_overlap(unseen, train, "review_text")
    assert V.assert_no_overlap(unseen.filter("id > 2"), train, "review_text").count() == 2


def test_keywords_count_rows_once(spark):
    df = spark.createDataFrame(
        [(["hate", "hate", "it"], "Negative"), (["hate"], "Positive"), (["love"], None)], "terms array<string>, sentiment string"
    )
    got = {r.word: tuple(r)[1:] for r in V.keyword_by_class(df, ["hate", "love", "absent"], "terms").collect()}
    assert got == {"hate": (2, 1, 0, 1), "love": (1, 0, 0, 0), "absent": (0, 0, 0, 0)}


# Scoring


@pytest.fixture(scope="module")
def model(spark):
    rows = [(f"terrible broken product {i}", "Negative") for i in range(10)]
    rows += [(f"package arrived today {i}", "Neutral") for i in range(10)]
    rows += [(f"excellent great quality {i}", "Positive") for i in range(10)]
    df = spark.createDataFrame(rows, "review_body string, sentiment string").withColumn("review_title", F.lit(""))
    return M.fit_sentiment_model(df, text_option="A", n_max=1, max_iter=50)[0]


TEXTS = [
    (1, "excellent quality phone"), (2, "I am not feeling well"), (3, None), (4, "  \n"), (5, "hello there"),
    (6, "This product is terrible"), (7, "the is at on we was"), (8, "unheard-of words about nothing special"),
]


def test_gated_scores(spark, model):
    got = {r.id: r for r in R.score_gated(spark.createDataFrame(TEXTS, "id long, review string"), model).collect()}
    assert len(got) == 8
    assert got[1].sentiment == "Positive" and got[6].sentiment == "Negative"
    for i in (2, 5):
        assert not got[i].is_valid_domain and got[i].sentiment is None and got[i].confidence == 0
        assert set(got[i].probabilities.values()) == {0.0} and got[i].nlp_steps.cleaned_text == got[i].cleaned_text
    for i in (3, 4):
        assert got[i].sentiment == "Neutral" and got[i].confidence == 0 and got[i].nlp_steps is None
        assert got[i].probabilities == {"Positive": 33.33, "Negative": 33.33, "Neutral": 33.34}
        assert got[i].cleaned_text == ""
    assert got[1].cleaned_text == "excellent quality phone"
    assert got[7].is_valid_domain and got[7].cleaned_text == "the is at on we was"
    assert got[1].nlp_steps.num_nonzero_features == 2
    assert got[8].nlp_steps.num_nonzero_features == 0 and got[8].nlp_steps.vocabulary_size == len(X.feature_terms(model))
    for i in (1, 6, 7, 8):
        assert sum(got[i].probabilities.values()) == pytest.approx(100, abs=0.02)
        assert got[i].confidence == max(got[i].probabilities.values())


@pytest.mark.parametrize("mode", ["raw", "processed"])
def test_stream_equals_batch(spark, model, tmp_path, mode):
    source = str(tmp_path / "in")
    df = spark.createDataFrame(TEXTS, "id long, review string").repartition(3)
    df.write.parquet(source)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        stream = spark.readStream.schema(df.schema).parquet(source)
        score_stream(stream, model, out, checkpoint, text_mode=mode).awaitTermination()

    run()
    more = spark.createDataFrame([(9, "great phone")], df.schema)
    more.write.mode("append").parquet(source)
    run()
    batch = R.score_gated(df.unionByName(more), model, text_mode=mode)
    got = spark.read.parquet(out)
    assert sorted(got.select(batch.columns).collect(), key=lambda r: r.id) == sorted(batch.collect(), key=lambda r: r.id)


def test_summary_sample_and_words(spark):
    rows = [(2, "good good phone", "Positive", 90.0), (1, "good case", "Positive", 80.0), (3, "bad", "Negative", 70.0)]
    df = spark.createDataFrame(rows, "id int, text string, predicted_sentiment string, confidence double")
    assert tuple(R.score_summary(df, "text").first()) == (3, 2, 1, 0, "text")
    assert [r.text for r in R.score_sample(df, "text", "id", 2).collect()] == ["good case", "good good phone"]
    assert [tuple(r) for r in R.top_words(df, "Positive", "text", 2).collect()] == [("good", 3), ("case", 1)]
    ranks = {(r.label, r["rank"]): r.word for r in R.top_words_per_label(df, "text", 2).collect()}
    assert ranks == {("Positive", 1): "good", ("Positive", 2): "case", ("Negative", 1): "bad"}
    true = df.withColumn("sentiment", F.lit("Neutral"))
    assert R.top_words(true, "Positive", "text").count() == 0


# Sources


def test_detect_text_column(spark):
    def names(schema):
        return spark.createDataFrame([], schema)

    assert detect_text_column(names("id int, body string, review string")) == "review"
    assert detect_text_column(names("id int, Review string, summary string")) == "summary"
    assert detect_text_column(names("id int, x string, y string")) == "x"
    assert detect_text_column(names("a string, b string"), "b") == "b"
    with pytest.raises(ValueError):
        detect_text_column(names("id int"))
    with pytest.raises(ValueError):
        detect_text_column(names("a string"), "missing")
    with pytest.raises(ValueError, match="empty"):
        validate_input(names("a string"))


def test_csv_keeps_line_ends_quotes_and_nulls(spark, tmp_path):
    rows = [("r1", "p", "u", 5, 'She said "wow",\nthen left', None, "en", "home"), ("r2", "p", "u", None, "", " t ", "en", "home")]
    path = str(tmp_path / "reviews.csv")
    write_table(spark.createDataFrame(rows, REVIEW_SCHEMA), path, "csv")
    rows[1] = rows[1][:4] + (None,) + rows[1][5:]  # empty text reads as NULL
    assert sorted(map(tuple, read_reviews(spark, path).collect()), key=lambda r: r[0]) == rows
    assert read_reviews(spark, path, schema=None).columns == REVIEW_SCHEMA.names
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_reviews(spark, str(tmp_path / "none.csv"))


def test_reports_are_json(spark, tmp_path):
    write_report(spark.createDataFrame([('{"a":{"b":1}}',)], "report string"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().a.b == 1
    write_report(spark.range(2), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 2
