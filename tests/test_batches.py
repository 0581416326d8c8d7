"""Work that is merged: sketches of parts, batches of reviews, windows of a stream, stages of a run."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from reviewloom.operators import incremental as I
from reviewloom.operators import metrics as V
from reviewloom.operators import sketches as K
from reviewloom.operators.cleaning import clean_reviews
from reviewloom.plans import catalog, review_run
from reviewloom.plans.manifest import Stages, table_digest
from reviewloom.plans.sample_reviews import sample_reviews
from reviewloom.schema import LABELS
from reviewloom.session import stage_path
from reviewloom.streaming import summary as W


def test_a_new_part_costs_only_its_own_sketch(spark):
    rng = random.Random(3)
    rows = [(day, "w " * rng.randint(0, 300), None if i % 50 == 0 else "t", i, f"p{i % 700}") for i in range(6000) for day in (i % 3,)]
    df = spark.createDataFrame(rows, "day int, review_body string, review_title string, review_id long, product_id string")
    first = K.length_sketches(df.filter("day < 2"), "day")
    merged = K.merge_length_stats(first.unionByName(K.length_sketches(df.filter("day = 2"), "day")))
    got = {r.measure: r for r in merged.collect()}
    words = sorted(len(b.split()) for _, b, *_ in rows)
    r = got["review_body_words"]
    assert (r.n, r.min, r.max) == (6000, words[0], words[-1]) and abs(r.mean - sum(words) / 6000) < 1e-9
    for q, rank in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)):
        below, upto = sum(w < r[q] for w in words) / 6000, sum(w <= r[q] for w in words) / 6000
        assert below - K.QUANTILE_ERROR <= rank <= upto + K.QUANTILE_ERROR
    assert all(v <= K.QUANTILE_ERROR for r in K.rank_errors(df, merged).collect() for v in r[1:])
    ids = K.distinct_sketches(df, "day", ("review_id", "product_id"))
    counts = K.merge_distinct_counts(ids).first()
    assert abs(counts.distinct_review_id - 6000) <= 3 * K.DISTINCT_ERROR * 6000
    assert abs(counts.distinct_product_id - 700) <= 3 * K.DISTINCT_ERROR * 700


def some_reviews(seed, n=200):
    rng = random.Random(seed)
    bodies = ["good", "bad", " good ", "", None, "  ", *(f"text {i}" for i in range(30))]
    ids = rng.sample(range(10_000), n)
    return [(i, "p", "u", rng.choice([1, 2, 3, 4, 5, None]), rng.choice(bodies), None, "en", "c") for i in ids]


SCHEMA = (
    "review_id long, product_id string, reviewer_id string, stars int, review_body string, "
    "review_title string, language string, product_category string"
)


@pytest.mark.parametrize("seed", range(3))
def test_batches_clean_like_one(spark, seed):
    rows = some_reviews(seed)
    cuts = sorted(random.Random(seed).sample(range(len(rows)), 3))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    log = I.BodyLog(spark, stage_path(spark, "log"))
    kept, seen = set(), []
    for number, batch in enumerate(batches):
        seen += batch
        df = spark.createDataFrame(batch, SCHEMA)
        if number == 2:  # a first try that wrote something else and failed
            log.add(spark.createDataFrame(some_reviews(99, 50), SCHEMA), number)
        for r in log.add(df, number).collect():
            (kept.add if r.action == "add" else kept.remove)(r.review_id)
        whole = {r.review_id for r in clean_reviews(spark.createDataFrame(seen, SCHEMA)).collect()}
        assert kept == whole == {r.review_id for r in log.kept().collect()}
    compact = log.compact(stage_path(spark, "log"))
    extra = [(20_000, "p", "u", 5, "bad", None, "en", "c"), (20_001, "p", "u", 1, "bad", None, "en", "c")]
    changes = compact.add(spark.createDataFrame(extra, SCHEMA), 1).collect()
    assert all(r.action == "retract" for r in changes)
    assert {r.review_id for r in compact.kept().collect()} == kept - {r.review_id for r in changes}


def test_changes_lead_from_one_clean_table_to_the_next(spark):
    first, second = some_reviews(7, 80), [(r[0] + 20_000, *r[1:]) for r in some_reviews(8, 80)]
    log = I.BodyLog(spark, stage_path(spark, "log"))
    one, both = spark.createDataFrame(first, SCHEMA), spark.createDataFrame(first + second, SCHEMA)
    log.add(one, 0)
    changes = log.add(spark.createDataFrame(second, SCHEMA), 1)
    got = I.apply_changes(clean_reviews(one), both, changes)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, clean_reviews(both).select(*got.columns).collect()))


T0 = datetime(2024, 1, 1)


def arriving(spark, tmp_path, batches):
    """One file a micro-batch: rows of (minute, label)."""
    folder = str(tmp_path / "in")
    for rows in batches:
        timed = [(T0 + timedelta(minutes=m), label, "one two two") for m, label in rows]
        df = spark.createDataFrame(timed, "time timestamp, predicted_sentiment string, processed_text string")
        df.coalesce(1).write.mode("append").parquet(folder)
    return lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_late_rows_are_told_not_counted(spark, tmp_path):
    # the third file comes when the watermark is at minute 290
    batches = [[(5, "Positive"), (70, "Negative")], [(300, "Neutral")], [(10, "Positive"), (20, "Positive"), (310, None)]]
    stream = arriving(spark, tmp_path, batches)
    a, s = str(tmp_path / "arrivals"), str(tmp_path / "summaries")
    W.stream_arrivals(stream(), a, str(tmp_path / "c1"), "time").awaitTermination()
    W.stream_summary(stream(), s, str(tmp_path / "c2"), "time", delay="10 minutes").awaitTermination()
    late = {(r.window_start - T0).total_seconds() / 3600: (r.arrived, r.late) for r in W.late_rows(spark, a, s).collect()}
    assert late == {0.0: (3, 2), 1.0: (1, 0), 5.0: (2, 0)}
    rows = {(r.window_start - T0).total_seconds() / 3600: tuple(r[2:]) for r in W.window_summaries(spark, s).collect()}
    assert rows == {0.0: (1, 1, 0, 0), 1.0: (1, 0, 1, 0), 5.0: (2, 0, 0, 1)}


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    stream = arriving(spark, tmp_path, [[(1, "Positive"), (2, "Positive")]])
    path, checkpoint = str(tmp_path / "words"), str(tmp_path / "c")
    W.stream_words(stream(), path, checkpoint, "time").awaitTermination()
    arriving(spark, tmp_path, [[(3, "Positive"), (61, "Negative")]])
    for _ in range(2):  # the second run finds nothing new
        W.stream_words(stream(), path, checkpoint, "time").awaitTermination()
    got = {(r.label, r.word, r.n, r.rank) for r in W.window_top_words(spark, path).collect()}
    assert got == {("Positive", "two", 6, 1), ("Positive", "one", 3, 2), ("Negative", "two", 2, 1), ("Negative", "one", 1, 2)}


def scored(spark, n, change=lambda i: None):
    rows = [(f"r{i}", "Positive", 0.1, 0.2, None if i % 5 == 0 else 0.7) if not change(i) else change(i) for i in range(n)]
    return spark.createDataFrame([r for r in rows if r != "gone"], "id string, predicted_sentiment string, " + ", ".join(f"prob_{c} double" for c in LABELS))


def test_only_differing_buckets_are_joined(spark):
    changed = {3: ("r3", "Negative", 0.1, 0.2, 0.7), 7: "gone", 10: ("r10", "Positive", 0.1, 0.2, 0.7), 11: ("r11", "Positive", 0.2, 0.1, 0.7)}
    a, b = scored(spark, 500), scored(spark, 500, changed.get)
    got = V.parity_by_buckets(a, b, "id", buckets=256)
    whole = {tuple(r) for r in V.parity_check(a, b, "id").collect()}
    found = {tuple(r) for r in got.collect()}
    assert found <= whole and {r for r in whole if not r[-1]} <= found and len(found) < 60
    assert {r[0] for r in found if not r[-1]} == {"r3", "r7", "r10", "r11"}


def test_equal_tables_send_digests_only(spark):
    a, b = scored(spark, 2000).repartition(5), scored(spark, 2000).repartition(3)
    differing = V.differing_buckets(a, b, "id", buckets=64)
    assert differing.count() == 0
    assert V.parity_by_buckets(a, b, "id", buckets=64).count() == 0


def test_poisson_weights_are_those_of_the_distribution(spark):
    rows = spark.range(200).select(F.explode(F.sequence(F.lit(0), F.lit(99))).alias("r"), "id")
    counts = Counter(r[0] for r in rows.select(V.poisson_weight(F.col("id"), F.col("r"))).collect())
    assert abs(counts[0] / 20_000 - 0.3679) < 0.02 and abs(counts[1] / 20_000 - 0.3679) < 0.02
    assert abs(sum(k * n for k, n in counts.items()) / 20_000 - 1) < 0.03


def test_intervals_narrow_with_the_rows(spark):
    rng = random.Random(2)
    rows = [(i, "large" if i % 50 else "small", rng.choice(LABELS), rng.choice(LABELS)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, product_category string, sentiment string, predicted_sentiment string")
    got = {r.product_category: r for r in V.domain_intervals(df, "id").collect()}
    for r in got.values():
        assert r.accuracy_low <= r.accuracy <= r.accuracy_high
    assert not got["large"].unstable and got["small"].unstable
    assert got["large"].accuracy_high - got["large"].accuracy_low < 0.06


def test_keyword_tables_hold_phrases(spark):
    texts = [("Positive", ["very", "good", "very", "good"]), ("Negative", ["good", "very"]), (None, ["very"]), ("Neutral", None)]
    df = spark.createDataFrame(texts, "sentiment string, words array<string>")
    keywords = spark.createDataFrame([("very good",), ("good",), ("good",), ("none of it",), ("",), (None,)], "keyword string")
    got = {tuple(r) for r in V.keyword_table_by_class(df, keywords, "words").collect()}
    assert got == {("very good", 1, 0, 0, 1), ("good", 2, 1, 0, 1), ("none of it", 0, 0, 0, 0)}
    assert V.keyword_table_by_class(df, keywords.limit(0), "words").count() == 0


def test_short_runs_are_not_sliced_one_by_one(spark):
    words = ["a", None, "b", "", "c d", "e", "f", "g", "h", "i", "j"]
    df = spark.createDataFrame([(words,), (["a"],), ([],), (None,)], "words array<string>")
    for n in (1, 2, 3, 8, 9, 11, 12):
        runs = V._runs("words", n)
        assert n > 8 or "array_join" not in str(runs)
        expected = [" ".join(w for w in words[i : i + n] if w is not None) for i in range(len(words) - n + 1)]
        got = [[w or "" for w in r[0]] for r in df.select(runs).collect()]
        assert got == [expected, ["a"] if n == 1 else [], [], []]


def test_a_span_of_time_is_several_files_and_one_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "ROWS_PER_FILE", 10)
    # the second of four spans has a single row, so that it is short of files
    seconds = [*range(100), 150, *range(200, 400), None]
    turns = spark.createDataFrame([(s, "t") for s in seconds], "s long, text string").select(F.timestamp_seconds("s").alias("time"), "text")
    stream = catalog._arriving(spark, turns, 4, (2, 0, 3, 1))
    found = []

    def note(batch, number):
        files = batch.select(F.input_file_name()).distinct().count()
        found.append((files, *batch.agg(F.min(F.unix_timestamp("time")), F.max(F.unix_timestamp("time")), F.count("text")).first()))

    stream.writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start().awaitTermination()
    spans = [(200, 299, 100), (0, 99, 100), (300, 399, 100), (150, 150, 1)]
    assert [f[1:] for f in found] == spans
    assert all(f[0] > 1 for f in found[:3])


class Killed(Exception):
    pass


def test_a_run_killed_after_any_stage_ends_with_the_same_tables(spark, sf_dir, tmp_path, monkeypatch):
    reviews = sample_reviews(spark, sf_dir, 7)
    options = {"seeds": range(42, 44), "max_iter": 2, "grid": review_run.models.EXPERIMENTS[2:3]}
    whole = review_run.run_review_pipeline(reviews, str(tmp_path / "whole"), **options)
    finish = Stages._write
    names, runs = [], 0

    def killed(self, name, **manifest):
        finish(self, name, **manifest)
        if manifest:
            names.append(name)
            raise Killed(name)

    monkeypatch.setattr(Stages, "_write", killed)
    while True:
        try:
            tables = review_run.run_review_pipeline(reviews, str(tmp_path / "killed"), **options)
            break
        except Killed:
            runs += 1
            assert runs < 30
    assert len(names) == len(set(names)) == runs  # every stage was made once
    volatile = {"experiments": ["fit_seconds"], "parity": []}
    for name, table in whole.items():
        assert table_digest(table.drop(*volatile.get(name, []))) == table_digest(tables[name].drop(*volatile.get(name, []))), name


def test_another_input_is_made_anew(spark, tmp_path):
    def run(value, setting=1):
        stages = Stages(spark, str(tmp_path))
        df = spark.createDataFrame([(value,)], "x int")
        stages.source("input", table_digest(df))
        stages.table("a", lambda: df, ["input"])
        out = stages.table("b", lambda: stages.read("a").withColumn("y", F.lit(setting)), ["a"], setting=setting)
        return out.first().x, stages.made

    assert run(1) == (1, ["a", "b"])
    assert run(1) == (1, [])
    assert run(1, 2) == (1, ["b"])
    assert run(2, 2) == (2, ["a", "b"])
    assert run(None, 2) == (None, ["a", "b"])
