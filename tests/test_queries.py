import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
import check
from reviewloom.operators.splitting import SPLITS
from reviewloom.plans.catalog import QUERIES
from reviewloom.plans.oracles import ORACLES
from reviewloom.plans.review_run import clean, run_review_pipeline
from reviewloom.plans.sample_reviews import sample_reviews

# the corpus queries have tests of their own
WITH_SQL = sorted(ORACLES)
WITHOUT_SQL = sorted(set(QUERIES) - set(WITH_SQL))


@pytest.fixture(scope="module")
def database(sf_dir):
    return check.connect(sf_dir)


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_sql(spark, sf_dir, database, name):
    df = entry_point.queries()[name](spark, sf_dir)
    assert check.compare(df, database, entry_point.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert not entry_point.queries()[name](spark, sf_dir).isEmpty()


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_whole_run(spark, sf_dir, tmp_path):
    reviews = sample_reviews(spark, sf_dir, 7).withColumn("review_id", F.col("review_id").cast("string"))
    unseen = spark.createDataFrame(
        [("home", "Positive", "I love this kettle", False), ("home", "Negative", "the lid broke", False)],
        "domain string, expected_sentiment string, review_text string, is_qualitative boolean",
    )
    tables = run_review_pipeline(reviews, str(tmp_path), unseen, seeds=range(42, 47), max_iter=3)
    cleaned, splits = tables["cleaned"], tables["splits"]
    assert splits.count() == cleaned.count() < reviews.count()
    assert {r.split for r in splits.select("split").distinct().collect()} == set(SPLITS)
    assert tables["scored"].count() == splits.filter("split = 'test'").count()
    assert tables["experiments"].count() == 5 and tables["unseen_report"].count() == 2
    assert tables["parity"].filter("NOT match").count() == 0
    report = json.loads(spark.read.text(f"{tmp_path}/audit").first().value)
    assert report["shape"]["n_rows"] == reviews.count()
    twice = clean(reviews.unionByName(reviews))
    assert sorted(r.review_id for r in twice.collect()) == sorted(r.review_id for r in cleaned.collect())
