import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from reviewloom.functions import labels as L
from reviewloom.operators import audit as A
from reviewloom.operators import cleaning as C
from reviewloom.schema import REVIEW_SCHEMA


@pytest.fixture(scope="module")
def reviews(spark):
    """1,200 reviews; one body fills a third, others repeat, agree or conflict."""
    rng = random.Random(3)
    rows = []
    for i in range(1200):
        if i % 3 == 0:
            body, stars = "  Same words everywhere ", 5
        elif i % 7 == 0:
            body, stars = f"conflict {i % 4}", rng.choice([1, 3, 5])
        elif i % 11 == 0:
            body, stars = rng.choice(["", " \n", "\xa0"]), 2
        else:
            body, stars = f"text {rng.randint(0, 500)}", 4
        title = None if i % 50 == 0 else f" t{i % 90} "
        rows.append((f"r{i:05d}", f"p{i % 40}", f"u{i % 9}", stars, body, title, "en", f"c{i % 5}"))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, REVIEW_SCHEMA).repartition(6)


def brute_force_clean(reviews, drop_empty=True):
    label = {1: "Negative", 2: "Negative", 3: "Neutral", 4: "Positive", 5: "Positive"}
    groups = {}
    for r in sorted(reviews.collect(), key=lambda r: r.review_id):
        groups.setdefault(r.review_body.strip(), []).append((r.review_id, label[r.stars]))
    return {
        rows[0][0]
        for body, rows in groups.items()
        if len({x[1] for x in rows}) == 1 and not (drop_empty and not body)
    }


@pytest.mark.parametrize("drop_empty", [True, False])
def test_clean_reviews_equals_brute_force(reviews, drop_empty):
    expected = brute_force_clean(reviews, drop_empty)
    got = C.clean_reviews(reviews, drop_empty=drop_empty).collect()
    assert {r.review_id for r in got} == expected and len(got) == len(expected)
    repeated = C.repeated_bodies(C.prepare_reviews(reviews))
    staged = C.clean_reviews(reviews, drop_empty=drop_empty, repeated=repeated)
    assert staged.columns == C.clean_reviews(reviews).columns
    assert sorted(r.review_id for r in staged.collect()) == sorted(expected)


def test_clean_reviews_keeps_one_of_identical_rows(spark):
    row = ("r1", "p", "u", 5, "same", "t", "en", "c")
    df = spark.createDataFrame([row] * 5, REVIEW_SCHEMA)
    assert C.clean_reviews(df).count() == 1
    assert C.dedup_keep_first(df).count() == 1


def test_steps_compose_to_clean(reviews):
    prepared = C.prepare_reviews(reviews)
    steps = C.dedup_keep_first(C.drop_conflicting(C.drop_empty_body(prepared)))
    assert sorted(steps.collect()) == sorted(C.clean_reviews(reviews).collect())


def test_duplicate_summary_counts_rows_and_texts(spark):
    rows = [(1, "a", "Positive", "p1"), (2, "a", "Positive", "p1"), (3, "b", "Positive", "p1"), (4, "b", "Neutral", "p2"),
            (5, "c", "Invalid", None), (6, "c", "Invalid", "p3"), (7, "d", "Positive", "p1")]
    df = spark.createDataFrame(rows, "review_id int, review_body string, sentiment string, product_id string")
    got = {r.kind: (r.n_rows, r.n_texts) for r in C.duplicate_summary(df).collect()}
    assert got == {"A": (4, 2), "B": (2, 1), "C": (4, 2)}
    assert C.duplicate_summary(df.limit(0)).count() == 3


def test_cleaning_report_adds_up(reviews):
    report = {(r.metric, r.label): r for r in C.cleaning_report(reviews).collect()}
    n = {k: r.n for k, r in report.items()}
    assert n["initial_rows", None] == 1200
    dropped = sum(n[m, None] for m in ("dropped_empty_body", "dropped_conflicting", "dropped_repeated"))
    assert dropped == n["dropped_total", None] and 1200 - dropped == n["final_rows", None]
    assert n["final_rows", None] == len(brute_force_clean(reviews))
    assert sum(r.percent for (m, _), r in report.items() if m == "final_class") == pytest.approx(100)


def test_labels(spark):
    df = spark.createDataFrame([(s,) for s in (1, 2, 3, 4, 5, 0, 6, None)], "s int")
    got = [r[0] for r in df.select(L.star_sentiment("s")).collect()]
    assert got == ["Negative"] * 2 + ["Neutral"] + ["Positive"] * 2 + ["Invalid"] * 3
    ratings = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.5, 3.0, 4.5, None)], "r double")
    got = [r[0] for r in ratings.select(L.rating_sentiment("r")).collect()]
    assert got == ["Negative", "Negative", "Positive", "Neutral", "Positive", "Positive"]
    assert L.invalid_star_filter(df, "s").count() == 3
    back = df.select(L.star_sentiment("s").alias("l")).filter("l != 'Invalid'")
    assert back.filter(L.label_name(L.label_index("l")) != F.col("l")).count() == 0


def test_group_and_length_stats_equal_statistics(reviews):
    sizes = {}
    for r in reviews.collect():
        sizes[r.reviewer_id] = sizes.get(r.reviewer_id, 0) + 1
    stats = A.group_size_stats(reviews, "reviewer_id").first()
    q = statistics.quantiles(sizes.values(), n=4, method="inclusive")
    assert stats.n_groups == 9 and (stats.min, stats.max) == (min(sizes.values()), max(sizes.values()))
    assert stats["std"] == pytest.approx(statistics.stdev(sizes.values()))
    assert [stats.q25, stats.median, stats.q75] == pytest.approx(q)
    words = [len((r.review_title or "").split()) for r in reviews.collect()]
    row = A.length_stats(reviews).filter("measure = 'review_title_words'").first()
    assert row["mean"] == pytest.approx(statistics.mean(words)) and row["std"] == pytest.approx(statistics.stdev(words))


def test_duplicates_treat_null_as_a_value(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 1), (None, 1), ("", 1), ("null", 1)], "t string, k int")
    assert A.duplicate_values(df, "t").first()[0] == 2
    assert A.duplicate_values(df, "t", drop_null=True).first()[0] == 1
    assert A.duplicate_rows(df).first()[0] == 2
    assert A.duplicate_rows(df.limit(0)).first()[0] == 0


def test_row_digest_keeps_column_limits_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("a:1:b", "c"), ("a", "1:b:c")], "x string, y string")
    assert A.duplicate_rows(df).first()[0] == 0


def test_profile_counts_nulls_and_blanks(reviews):
    profile = {r.column_name: r for r in A.column_profile(reviews).collect()}
    rows = reviews.collect()
    assert profile["review_title"].n_null == sum(r.review_title is None for r in rows)
    assert profile["review_body"].n_blank == sum(not r.review_body.strip() for r in rows)
    assert profile["stars"].n_blank is None and profile["stars"].data_type == "int"


def test_audit_report_is_one_json_document(reviews):
    report = json.loads(A.audit_report(reviews).collect()[0].report)
    assert report["shape"] == {"n_rows": 1200, "n_columns": 8}
    assert sum(report["star_distribution"].values()) == 1200
    assert sum(report["sentiment_percent"].values()) == pytest.approx(100)
    assert sum(sum(c.values()) for c in report["category_by_stars"].values()) == 1200
    assert report["missing_values"]["review_title"] == reviews.filter("review_title IS NULL").count()
