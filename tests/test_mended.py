"""Answers that were once wrong, and limits that are refused."""

import pytest
from pyspark.errors import PySparkException

from reviewloom.functions.text import lemmatize_with_table
from reviewloom.operators import cleaning as C
from reviewloom.operators import features as X
from reviewloom.operators import metrics as V
from reviewloom.operators import models as M
from reviewloom.operators import splitting as G

SCORED = "id long, predicted_sentiment string, prob_Negative double, prob_Neutral double, prob_Positive double"


def test_parity_sees_probabilities_that_are_missing(spark):
    a = spark.createDataFrame([(1, "Neutral", 0.1, 0.2, 0.7), (2, "Neutral", None, None, None), (3, "Neutral", None, 0.5, 0.5)], SCORED)
    b = spark.createDataFrame([(1, "Neutral", None, None, None), (2, "Neutral", None, None, None), (3, "Neutral", 0.0, 0.5, 0.5)], SCORED)
    got = {r.id: r.match for r in V.parity_check(a, b, "id").collect()}
    assert got == {1: False, 2: True, 3: False}


def test_parity_refuses_repeated_keys(spark):
    a = spark.createDataFrame([(1, "Neutral", 0.1, 0.2, 0.7)], SCORED)
    with pytest.raises(PySparkException, match="more than once"):
        V.parity_check(a.unionByName(a), a, "id").collect()


def test_lemma_table_with_repeats_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (1, ["b"]), (2, []), (3, None), (None, ["a"])], "id long, tokens array<string>")
    lemmas = spark.createDataFrame([("a", "x"), ("a", "w"), ("b", "b"), (None, "z")], "token string, lemma string")
    got = lemmatize_with_table(df, "tokens", lemmas, "id").collect()
    expected = [(1, ["a", "b", "a"], ["w", "b", "w"]), (1, ["b"], ["b"]), (2, [], []), (3, None, []), (None, ["a"], ["w"])]
    assert sorted(((r.id, r.tokens, r.lemmas) for r in got), key=repr) == sorted(expected, key=repr)


def test_repeated_keywords_count_once(spark):
    df = spark.createDataFrame([("Neutral", ["a", "b"]), ("Positive", ["a"])], "sentiment string, terms array<string>")
    got = {r.word: (r.n_total, r.n_Neutral) for r in V.keyword_by_class(df, ["a", "a", "c"], "terms").collect()}
    assert got == {"a": (2, 1), "c": (0, 0)}


def test_fitted_terms_are_alphabetical(spark):
    df = spark.createDataFrame([("zeta alpha mid",), ("zeta alpha",), ("zeta mid",)], "text string")
    model = X.fit_features(df, "text", 1)
    assert X.feature_terms(model) == ["alpha", "mid", "zeta"]
    with pytest.raises(ValueError, match="max_features"):
        X.fit_features(df, "text", 1, max_features=None)


REVIEW = "review_id long, product_id string, stars int, review_body string, review_title string"


def test_cleaning_with_a_hot_body_and_repeated_ids(spark):
    rows = [(i, f"p{i}", 5, "the same" if i % 3 == 0 else f"body {i}", None) for i in range(300)]
    rows += [(7, "other", 5, "body 7", None), (8, "p8", 5, "body 8", None), (9, "p9", 1, "clash", "t"), (10, "p", 5, "clash", "t")]
    reviews = spark.createDataFrame(rows, REVIEW).repartition(4)
    got = C.clean_reviews(reviews).collect()
    bodies = [r.review_body for r in got]
    assert len(bodies) == len(set(bodies)) == 201  # one of each but the contradictory one
    assert next(r.review_id for r in got if r.review_body == "the same") == 0
    # of two rows with one id the digest decides, and of equal rows one stays
    assert sum(r.review_id == 7 for r in got) == sum(r.review_id == 8 for r in got) == 1
    first = C.dedup_keep_first(C.prepare_reviews(reviews))
    assert first.count() == 202


def test_unknown_splits_and_labels_are_told(spark):
    df = spark.createDataFrame([("a", "train"), ("b", "oops")], "product_id string, split string")
    with pytest.raises(PySparkException, match="unknown split: oops"):
        G.split_leakage(df).collect()
    labels = spark.createDataFrame([("Neutral",), ("Invalid",), (None,)], "sentiment string")
    assert M.untrainable_rows(labels) == 2


def test_lemma_table_with_many_changes_in_a_row(spark):
    """Changes are dealt to several maps, and rows are neither written as JSON nor made distinct in a shuffle of their own."""
    tokens = [f"w{i}" for i in range(3000)]
    df = spark.createDataFrame([(1, tokens), (1, tokens), (2, tokens[:3]), (None, tokens[::7])], "id long, tokens array<string>")
    lemmas = spark.createDataFrame([(t, t + "x") for t in tokens[::2]], "token string, lemma string")
    out = lemmatize_with_table(df, "tokens", lemmas, "id")
    known = set(tokens[::2])
    got = out.collect()
    assert len(got) == 4 and all(r.lemmas == [t + "x" if t in known else t for t in r.tokens] for r in got)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in plan and "collect_set" in plan and "pmod" in plan
