import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from reviewloom.functions import labels as L
from reviewloom.operators import features as X
from reviewloom.operators import metrics as V
from reviewloom.operators import logistic
from reviewloom.operators import models as M
from reviewloom.operators import scoring as R
from reviewloom.schema import LABELS
from reviewloom.sources.tables import load_pipeline, save_pipeline

WORDS = {
    "Negative": "broken terrible awful refund defective waste".split(),
    "Neutral": "okay average fine arrived package colors".split(),
    "Positive": "excellent love great perfect happy amazing".split(),
}
COMMON = "the product battery phone quality été 10x and is".split()


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(11)
    rows = []
    for i in range(240):
        label = rng.choices(LABELS, weights=(3, 1, 4))[0]
        words = rng.choices(WORDS[label], k=3) + rng.choices(COMMON, k=rng.randint(1, 8))
        rng.shuffle(words)
        rows.append((i, " ".join(words), label, f"Title {words[0]}"))
    rows.append((240, "", "Positive", None))
    return spark.createDataFrame(rows, "review_id long, review_body string, sentiment string, review_title string")


def expected_terms(text, n_max):
    words = re.findall(r"(?u)\b\w\w+\b", (text or "").lower())
    return words + [" ".join(words[i : i + n]) for n in range(2, n_max + 1) for i in range(len(words) - n + 1)]


def expected_tfidf(docs, n_max=1, min_df=2, max_features=50_000, sublinear=False):
    terms = [expected_terms(d, n_max) for d in docs]
    df = Counter(t for doc in terms for t in set(doc))
    cf = Counter(t for doc in terms for t in doc)
    kept = sorted((t for t in df if df[t] >= min_df), key=lambda t: (-cf[t], t))[:max_features]
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in kept}
    out = []
    for doc in terms:
        tf = {t: (1 + math.log(n) if sublinear else n) * idf[t] for t, n in Counter(doc).items() if t in idf}
        norm = math.sqrt(sum(w * w for w in tf.values()))
        out.append({t: w / norm for t, w in tf.items()})
    return out


@pytest.mark.parametrize("n_max", [1, 2, 3])
def test_terms(spark, n_max):
    docs = ["a bb CC dd_1 é éé", "", None, "one", "x y z", "İstanbul naïve 12 3"]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, t string")
    got = [r.terms for r in X.with_terms(df, "t", n_max).orderBy("id").collect()]
    assert got == [expected_terms(d, n_max) for d in docs]


@pytest.mark.parametrize("options", [{}, {"n_max": 2}, {"n_max": 2, "max_features": 40}, {"min_df": 1, "sublinear": True}])
def test_tfidf_equals_the_formula(texts, options):
    rows = texts.orderBy("review_id").collect()
    expected = expected_tfidf([r.review_body for r in rows], **options)
    sublinear = options.get("sublinear", False)
    fit = {k: v for k, v in options.items() if k != "sublinear"}
    model = X.fit_features(texts, "review_body", **({"n_max": 1} | fit))
    got = [{} for _ in rows]
    for r in X.tfidf_table(texts, model, "review_body", "review_id", sublinear=sublinear).collect():
        got[r.review_id][r.term] = r.weight
    for a, b in zip(got, expected, strict=True):
        assert a.keys() == b.keys() and all(a[t] == pytest.approx(b[t], abs=1e-12) for t in a)


def test_vocabulary_cut_breaks_ties_by_term(spark):
    df = spark.createDataFrame([(["b", "a", "c"],), (["b", "a", "c", "c"],), (["d"],)], "terms array<string>")
    got = [tuple(r) for r in X.vocabulary(df, min_df=1, max_features=2).collect()]
    assert got == [("c", 2, 3), ("a", 2, 2)]
    assert X.vocabulary(df, min_df=2, max_features=None).count() == 3


def test_runs_are_counted_in_blocks_as_in_lists(spark, monkeypatch):
    lists = [["a", "b", "a", "b"], [], None, ["b"], ["a", "b", "c"], ["é", "a", "b", "é", "a", "b"]]
    df = spark.createDataFrame([(w,) for w in lists], "words array<string>").coalesce(1)
    df_of, cf_of = Counter(), Counter()
    for words in filter(None, lists):
        runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
        cf_of.update(runs)
        df_of.update(set(runs))
    for most in (1, 5, 1000):
        monkeypatch.setattr(X.term_counts, "COUNTED_AT_ONCE", most)
        got = {r.term: (r.df, r.cf) for r in X.vocabulary(df, "words", 1, None, n_max=3).collect()}
        assert got == {t: (df_of[t], cf_of[t]) for t in cf_of}
    # a block sends one row for each of its terms, however often they occur
    assert X.partial_counts(df, "words", 3).count() == len(cf_of)
    filtered = X.vocabulary(df, "words", 2, None, prefilter_cells=2**10, n_max=3).collect()
    assert {r.term for r in filtered} == {t for t in cf_of if df_of[t] >= 2}


def test_vectors_have_length_one_or_zero(texts):
    model = X.fit_features(texts, "review_body", 2)
    for features in (
        X.transform_features(model, texts, "review_body"),
        X.sublinear_features(texts, model, "review_body"),
    ):
        square = F.aggregate(vector_to_array(X.FEATURES), F.lit(0.0), lambda a, x: a + x * x)
        lengths = {r.review_id: r.s for r in features.select("review_id", square.alias("s")).collect()}
        assert lengths.pop(240) == 0.0
        assert all(s == pytest.approx(1) for s in lengths.values())
    stats = X.feature_stats(X.transform_features(model, texts, "review_body"), model)
    assert stats.filter("review_id = 240").first().num_nonzero_features == 0


def test_no_vocabulary_is_an_error(spark):
    with pytest.raises(ValueError, match="no term"):
        X.fit_features(spark.createDataFrame([("a b",)], "t string"), "t")


def test_balanced_weights_sum_to_the_rows(texts):
    counts = Counter(r.sentiment for r in texts.collect())
    weights = {r.sentiment: r.weight for r in M.class_weights(texts).collect()}
    assert weights == pytest.approx({c: 241 / (3 * counts[c]) for c in LABELS})
    assert M.balanced_weights(texts).agg(F.sum(M.WEIGHT)).first()[0] == pytest.approx(241)


def test_logistic_reaches_the_minimum_of_the_objective(texts):
    """Gradient of 0.5 |w|^2 + C sum(weight * loss) is near zero; intercepts are free."""
    rows = M.training_rows(texts).withColumn("t", L.text_representation("A"))
    features = X.fit_features(rows, "t", 1)
    vectors = M.balanced_weights(X.transform_features(features, rows, "t"))
    model = M.fit_logistic(vectors, tol=1e-9)
    data = vectors.select(vector_to_array(X.FEATURES), M.LABEL, M.WEIGHT).collect()
    x, y, w = (np.array([r[i] for r in data]) for i in range(3))
    coefficients = model.coefficientMatrix.toArray()
    scores = x @ coefficients.T + model.interceptVector.toArray()
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    error = (p - np.eye(3)[y.astype(int)]) * w[:, None]
    assert np.abs(error.T @ x + coefficients).max() < 0.02
    assert np.abs(error.sum(axis=0)).max() < 0.05
    assert np.abs(coefficients.sum(axis=0)).max() < 1e-6


def test_naive_bayes_table_equals_numpy(texts):
    model = X.fit_features(texts, "review_body", 1)
    weights = X.tfidf_table(texts, model, "review_body", "review_id", "sentiment")
    terms, priors = M.naive_bayes_table(weights, texts)
    docs = texts.orderBy("review_id").collect()
    tfidf = expected_tfidf([r.review_body for r in docs])
    names = sorted({t for d in tfidf for t in d})
    x = np.array([[d.get(t, 0.0) for t in names] for d in tfidf])
    y = np.array([LABELS.index(r.sentiment) for r in docs])
    sums = np.array([x[y == k].sum(axis=0) + 1 for k in range(3)])
    log_prob = np.log(sums / sums.sum(axis=1, keepdims=True))
    log_prior = np.log(np.bincount(y) / len(y))
    got = {(r["class"], r.term): r.log_prob for r in M.by_class(terms, "log_prob", "term").collect()}
    assert len(got) == 3 * len(names)
    for k, c in enumerate(LABELS):
        assert [got[c, t] for t in names] == pytest.approx(list(log_prob[k]))
    best = (x @ log_prob.T + log_prior).argmax(axis=1)
    scored = M.score_naive_bayes(weights, texts, terms, priors, "review_id").collect()
    assert {r.review_id: r.predicted_sentiment for r in scored} == {
        r.review_id: LABELS[best[i]] for i, r in enumerate(docs)
    }


@pytest.fixture(scope="module")
def fitted(texts):
    return M.fit_sentiment_model(texts, text_option="A", n_max=2, max_iter=60)


def test_batch_scores(texts, fitted, spark):
    model, settings = fitted
    scored = R.score_batch(texts, model, "review_body", settings["text_mode"], True, True)
    assert scored.columns[: len(texts.columns)] == texts.columns
    rows = scored.collect()
    assert len(rows) == 241
    for r in rows:
        p = {c: r[f"prob_{c}"] for c in LABELS}
        assert sum(p.values()) == pytest.approx(1) and r.predicted_sentiment == max(p, key=p.get)
        assert r.confidence == pytest.approx(100 * max(p.values()), abs=0.006)
    assert np.mean([r.sentiment == r.predicted_sentiment for r in rows]) > 0.9
    again = R.score_batch(scored, model, "review_body")
    assert sorted(again.columns) == sorted(scored.columns) and again.count() == 241


def test_saved_pipeline_gives_the_same_scores(texts, fitted, spark, tmp_path):
    model, settings = fitted
    save_pipeline(model, str(tmp_path / "m"), **settings)
    loaded, kept = load_pipeline(spark, str(tmp_path / "none"), str(tmp_path / "m"))
    assert kept == settings
    a, b = (R.score_batch(texts, m, "review_body", with_probabilities=True) for m in (model, loaded))
    assert V.parity_check(a, b, "review_id").filter("NOT match").count() == 0
    with pytest.raises(FileNotFoundError):
        load_pipeline(spark, str(tmp_path / "none"))


def test_experiments_and_selection(texts):
    train, val = texts.filter("review_id % 4 != 0"), texts.filter("review_id % 4 = 0")
    results = M.run_experiments(train, val, max_iter=3)
    rows = results.orderBy("exp_no").collect()
    assert [r.exp_no for r in rows] == [1, 2, 3, 4, 5]
    assert all(0 <= r.macro_f1 <= 1 and r.fit_seconds > 0 for r in rows)
    best = M.select_best(results).first()
    assert best.macro_f1 == max(r.macro_f1 for r in rows)
    tied = results.withColumn("macro_f1", F.lit(0.5))
    assert M.select_best(tied).first().exp_no == 1
    model, settings = M.train_final(train, val, best, max_iter=5)
    assert settings["text_option"] == best.text_option and len(X.feature_terms(model)) == settings["vocabulary_size"]


def test_contributions_sum_to_the_raw_score(texts, fitted):
    model, _ = fitted
    parts = M.feature_contributions(texts, model, "review_body", "review_id")
    sums = {
        r.review_id: r
        for r in parts.groupBy("review_id").agg(*[F.sum(f"contribution_{c}").alias(c) for c in LABELS]).collect()
    }
    raw = model.transform(texts.withColumn(X.TEXT, F.col("review_body"))).select("review_id", vector_to_array(M.RAW).alias("raw"))
    intercept = model.stages[-1].interceptVector.toArray()
    for r in raw.collect():
        for k, c in enumerate(LABELS):
            total = sums[r.review_id][c] if r.review_id in sums else 0.0
            assert total + intercept[k] == pytest.approx(r.raw[k], abs=1e-9)


def test_unknown_terms(spark, fitted):
    df = spark.createDataFrame([(1, "excellent zzyzx zzyzx")], "id long, t string")
    got = {r.term for r in M.unknown_terms(df, fitted[0], "t", "id").collect()}
    assert got == {"zzyzx", "excellent zzyzx", "zzyzx zzyzx"}


def test_text_mode_is_checked():
    with pytest.raises(ValueError, match="text mode"):
        M.model_text("A", "cooked")
    with pytest.raises(ValueError, match="text option"):
        M.model_text("C")


def test_solver_sums_many_tasks_on_the_executors(texts, monkeypatch):
    """With more tasks than any limit the driver still gets one vector a pass, and the minimum is the same."""
    rows = M.training_rows(texts).withColumn("t", L.text_representation("A"))
    vectors = M.balanced_weights(X.transform_features(X.fit_features(rows, "t", 1), rows, "t"))
    tasks, sizes = [], []
    total = logistic._total

    def spied(packed, run, size):
        tasks.append(packed.rdd.getNumPartitions())
        partial = packed.mapInArrow(run, "block int, sums binary").groupBy("block").applyInArrow(logistic._sum_block, "block int, sums binary")
        sizes.append(sum(len(r.sums) for r in partial.collect()) == 8 * size)
        return total(packed, run, size)

    one = M.fit_logistic(vectors, entries_per_task=10**9)
    monkeypatch.setattr(logistic, "_total", spied)
    many = M.fit_logistic(vectors, entries_per_task=1, max_iter=1)
    assert min(tasks) > 1 and all(sizes)
    monkeypatch.undo()
    many = M.fit_logistic(vectors, entries_per_task=1)
    assert many.training.converged and one.training.converged
    assert np.abs(many.coefficientMatrix.toArray() - one.coefficientMatrix.toArray()).max() < 1e-2


def test_curvature_saves_passes():
    scale = np.logspace(0, 5, 400)
    bowl = lambda p: (0.5 * (scale * (p - 1) ** 2).sum(), scale * (p - 1))
    point, plain = logistic.minimise(bowl, np.zeros(400), 1000, 1e-6)
    scaled, begun = logistic.minimise(bowl, np.zeros(400), 1000, 1e-6, scale)
    assert begun.converged and begun.passes < plain.passes / 4
    assert np.abs(scaled - 1).max() < 1e-5


def test_experiments_side_by_side_are_those_in_a_row(texts):
    train, val = texts.filter("review_id % 4 != 0"), texts.filter("review_id % 4 = 0")
    kept = ["exp_no", "n_features", "n_train", "n_val", "accuracy", "macro_f1", "converged"]
    grid = M.EXPERIMENTS[3:]
    together, alone = (M.run_experiments(train, val, grid, parallelism=n, max_iter=2).select(kept).collect() for n in (2, 1))
    assert together == alone


def test_training_texts_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        made.add(1)
        return text

    rows = [(i, "Positive" if i % 2 else "Negative", f"good{i % 3} words here {i % 2}") for i in range(30)]
    df = spark.createDataFrame(rows, "review_id int, sentiment string, text string")
    train = df.withColumn("review_title", F.lit("t")).withColumn("review_body", counted("text"))
    model, settings = M.fit_sentiment_model(train, classifier="naive_bayes", text_mode="processed", min_df=1)
    assert made.value == len(rows)
    assert settings["vocabulary_size"] == len(X.feature_terms(model)) and settings["untrainable_rows"] == 0
