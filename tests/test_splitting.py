import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewloom.operators import splitting as G
from reviewloom.schema import LABELS


@pytest.fixture(scope="module")
def reviews(spark):
    """900 reviews of 130 products; one product holds a third of them."""
    rng = random.Random(5)
    rows = [
        (i, "hot" if i % 3 == 0 else f"p{rng.randint(0, 128)}", rng.choices(LABELS, weights=(4, 2, 5))[0])
        for i in range(900)
    ]
    return spark.createDataFrame(rows, "review_id long, product_id string, sentiment string").repartition(5)


def expected_split(products, seed):
    order = sorted(products, key=lambda p: (hashlib.md5(f"{p}:{seed}".encode()).hexdigest(), p))
    n_train = math.floor(0.70 * len(order))
    n_val = math.floor(0.50 * (len(order) - n_train))
    names = ["train"] * n_train + ["val"] * n_val + ["test"] * (len(order) - n_train - n_val)
    return dict(zip(order, names, strict=True))


def expected_divergence(rows, split):
    def shares(part):
        n = Counter(r.sentiment for r in part)
        return {c: n[c] / len(part) if part else 0.0 for c in LABELS}

    whole = shares(rows)
    return sum(
        abs(shares([r for r in rows if split[r.product_id] == s])[c] - whole[c]) for s in G.SPLITS for c in LABELS
    )


@pytest.mark.parametrize("seed", [0, 42, 99])
def test_group_split_equals_a_full_sort(reviews, seed):
    got = G.group_split(reviews, seed=seed).collect()
    expected = expected_split({r.product_id for r in got}, seed)
    assert {r.product_id: r.split for r in got} == expected and len(got) == 900


def test_group_split_plan_moves_no_rows(reviews, capsys):
    G.group_split(reviews.select("*"), seed=1).explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and "Window" not in plan and plan.count("Exchange") <= 1


@pytest.mark.parametrize("n_groups", [1, 2, 3, 7])
def test_few_groups(spark, n_groups):
    df = spark.createDataFrame([(f"g{i % n_groups}",) for i in range(20)], "product_id string")
    got = {r.product_id: r.split for r in G.group_split(df).collect()}
    assert got == expected_split(set(got), 42)
    scored = df.withColumn("sentiment", F.lit("Positive"))
    assert G.seed_scores(scored, seeds=[42]).count() == 1


def test_seed_scores_equal_brute_force(reviews):
    rows = reviews.collect()
    products = {r.product_id for r in rows}
    scores = {r.seed: r.divergence for r in G.seed_scores(reviews, seeds=range(42, 62)).collect()}
    assert set(scores) == set(range(42, 62))
    for seed, divergence in scores.items():
        assert divergence == pytest.approx(expected_divergence(rows, expected_split(products, seed)))
    labelled, seed, divergence = G.best_group_split(reviews, seeds=range(42, 62))
    assert seed == min(scores, key=lambda s: (round(scores[s], 12), s)) and divergence == scores[seed]
    assert {r.product_id: r.split for r in labelled.collect()} == expected_split(products, seed)


def test_empty_split_counts_the_whole_share(spark):
    df = spark.createDataFrame([("a", "Positive"), ("b", "Negative")], "product_id string, sentiment string")
    rows = df.collect()
    for r in G.seed_scores(df, seeds=range(3)).collect():
        assert r.divergence == pytest.approx(expected_divergence(rows, expected_split({"a", "b"}, r.seed)))


def test_leakage_is_found(spark):
    rows = [("a", "train"), ("a", "val"), ("b", "val"), ("b", "test"), ("c", "train"), ("c", "test"), ("d", "test"),
            ("a", "test")]
    df = spark.createDataFrame(rows, "product_id string, split string")
    assert tuple(G.split_leakage(df).first()) == (1, 2, 2)
    with pytest.raises(ValueError, match="product_id"):
        G.assert_no_leakage(df)


def test_split_report_population_is_the_sum(reviews):
    report = {r.split: r for r in G.split_report(G.group_split(reviews)).collect()}
    parts = [report[s] for s in G.SPLITS]
    for column in ("n_rows", "n_keys", *[f"n_{c}" for c in LABELS]):
        assert report["population"][column] == sum(p[column] for p in parts)
    assert sum(p.percent_rows for p in parts) == pytest.approx(100)


def test_stratified_split_keeps_exact_quotas(reviews):
    split = G.stratified_split(reviews, test_fraction=0.2).collect()
    counts = Counter(r.sentiment for r in split)
    test = Counter(r.sentiment for r in split if r.split == "test")
    assert sum(test.values()) == math.ceil(0.2 * 900) and len(split) == 900
    for c in LABELS:
        assert abs(test[c] - 0.2 * counts[c]) < 1


def test_sample_per_class(reviews):
    small = reviews.filter("sentiment != 'Neutral'").unionByName(reviews.filter("sentiment = 'Neutral'").limit(3))
    sample = Counter(r.sentiment for r in G.sample_per_class(small, 20).collect())
    assert sample == {"Negative": 20, "Neutral": 3, "Positive": 20}


def test_union_matches_columns_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([("y", 2)], "v string, k int")
    got = G.union_splits(G.with_split(a, "train"), G.with_split(b, "val")).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "x", "train"), (2, "y", "val")]


@pytest.mark.parametrize("digits", [1, 2])
@pytest.mark.parametrize("ranked", [0, 20, 10**6])
def test_cuts_by_levels_equal_a_sort(spark, digits, ranked):
    rng = random.Random(digits)
    members = [(s, hashlib.md5(f"{s}:{rng.randint(0, 400)}".encode()).hexdigest() + "x") for s in "aab" for _ in range(300)]
    members += [("a", "0" * 32 + "tie")] * 5 + [("b", "f" * 32), ("empty", None)]
    quotas = [(s, f"cut{q}", q) for s in "abc" for q in (0, 1, 3, 7, 299, 300, 301, 605, 606, 10**6)]
    got = G.rank_cuts(
        spark.createDataFrame(members, "s string, position string").repartition(4),
        ["s"],
        spark.createDataFrame(quotas, "s string, cut string, quota long"),
        digits=digits,
        ranked=ranked,
    ).collect()
    expected = set()
    for s, cut, q in quotas:
        order = sorted(p for t, p in members if t == s)
        if 0 < q <= len(order):
            expected.add((s, cut, order[q - 1]))
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_a_level_shuffles_few_counts(spark):
    """All seeds over 20,000 keys: a task sends at most 256 counts a seed."""
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("product_id")).repartition(4)
    trials = keys.select("product_id", F.explode(F.lit(list(range(10)))).alias("seed"))
    members = trials.select("seed", G.hash_position("product_id", F.col("seed")).alias("position"))
    quotas = spark.createDataFrame([(s, "train", 14_000) for s in range(10)], "seed int, cut string, quota long")
    edges, rows = G._next_level(members, ["seed"], quotas.select("seed", F.lit("").alias("beginning"), "cut", F.col("quota").alias("wanted")), 0, 2)
    assert edges.count() == 10 and rows.count() < 10 * 20_000 / 256 * 2
    assert G.rank_cuts(members, ["seed"], quotas).count() == 10
