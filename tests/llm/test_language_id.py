import math

import numpy as np
import pytest

from reviewloom.llm import language_id
from reviewloom.llm.catalog import op1_language_id


@pytest.fixture(scope="module")
def predictions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = op1_language_id(spark, "/root/testdata/sf0.01").collect()
    return {r.doc_id: r for r in rows}, {r.doc_id: r for r in docs.collect()}


def test_held_out_accuracy(predictions):
    found, docs = predictions
    assert set(found) == set(docs)
    held = [r for r in found.values() if r.held_out]
    assert 0.2 < len(held) / len(found) < 0.3
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in found.values())


def test_clean_documents_are_not_rejected(predictions):
    found, _ = predictions
    assert sum(r.rejected for r in found.values()) <= len(found) // 500


def test_the_split_is_by_crc32(spark, documents):
    import zlib

    got = documents([(i, "some words") for i in range(50)])
    rows = got.select("doc_id", (~language_id.learnable(got)).alias("held")).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


@pytest.fixture(scope="module")
def model(spark):
    return language_id.fit_language_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 150)


def test_awkward_rows(documents, awkward, model):
    docs = documents(awkward)
    got = language_id.identify_languages(docs, model).collect()
    assert len(got) == len(awkward)
    by_id = {r.doc_id: r for r in got}
    for i in (6, 7, 8, 23):  # no text, or no letter
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].rejected) == ("und", 0.0, True)
    assert all(r.lang_pred in (*model.labels, "und") for r in got)
    assert by_id[24].lang_pred != "und" and by_id[24].rejected  # letters, but of no language learned
    left = language_id.keep_identified(docs, model)
    assert left.columns == docs.columns
    assert left.count() == sum(not r.rejected for r in got)


def test_without_labels_or_rows(spark, documents):
    docs = documents([(1, "words here"), (4, None)]).withColumn("lang", language_id.F.lit(None).cast("string"))
    assert [(r.lang_pred, r.rejected) for r in language_id.identify_languages(docs).collect()] == [("und", True)] * 2
    assert language_id.identify_languages(documents([])).count() == 0
    one = documents([(i, f"only one label {i}") for i in range(9)]).withColumn("lang", language_id.F.lit("xx"))
    assert {r.lang_pred for r in language_id.identify_languages(one).collect()} == {"xx"}


def test_the_sample_is_bounded_and_its_rows_may_be_learned_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sample, labels = language_id.labelled_sample(docs, 50)
    assert labels == 4 and 100 < sample.count() <= 400
    learnable = docs.filter(language_id.learnable(docs)).select(language_id.utf8("text").alias("text"))
    assert sample.join(learnable, "text", "left_anti").isEmpty()


def test_long_texts_lose_no_subword(monkeypatch):
    text = "Über allen Gipfeln ist Ruh, " * 40
    whole = np.sort(np.concatenate(list(language_id.subwords(text))))
    monkeypatch.setattr(language_id, "_PIECE", 97)
    assert (np.sort(np.concatenate(list(language_id.subwords(text)))) == whole).all()
    assert language_id.bag(text)[1].sum() == pytest.approx(1)


@pytest.mark.parametrize("left_out", ["en", "fr", "de", "es"])
def test_a_language_without_a_label_is_rejected(spark, left_out):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    other = docs["lang"] == left_out
    model = language_id.fit_language_model(docs.filter(~other))
    rows = language_id.identify_languages(docs.filter(other & (language_id.F.length("text") > 40)), model).select("rejected").collect()
    known = language_id.identify_languages(docs.filter(~other), model).select("rejected").collect()
    assert len(rows) > 100 and sum(r.rejected for r in rows) > 0.9 * len(rows)
    assert sum(r.rejected for r in known) <= 0.005 * len(known)


def test_the_limit_follows_the_stated_share():
    odds = np.random.default_rng(3).exponential(2, 20_000) + 1
    logits = np.column_stack([odds, np.zeros(len(odds))])
    assert language_id.rejection_limit(logits, 0.01) == pytest.approx(1 / (1 + np.exp(-np.quantile(odds, 0.01))), abs=1e-3)
    few = 15 - np.random.default_rng(4).exponential(1, (300, 2000))  # 4 rows of 2000 are one in 500
    limits = [language_id.rejection_limit(np.column_stack([o, np.zeros(2000)]), 0.002) for o in few]
    assert np.mean([(few < np.log(p / (1 - p))).mean() for p in limits[:50]]) == pytest.approx(0.002, rel=0.3)
    short = np.column_stack([few[0, :400], np.zeros(400)])
    assert language_id.rejection_limit(short, 0.002) == pytest.approx(1 / (1 + np.exp(-few[0, :400].min())))


def test_copies_share_a_fold_and_only_whole_texts_calibrate():
    assert language_id.fold_of("Some  Words\nhere") == language_id.fold_of("some words here")
    assert {language_id.fold_of(f"text {i}") for i in range(50)} == set(range(language_id.FOLDS))
    import pyarrow as pa

    text = b"one two three four five six seven eight"
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "en"], "text": pa.array([text, text], pa.binary())})
    rows = pa.Table.from_batches(list(language_id._bags(3)(iter([batch])))).to_pylist()
    assert len({r["fold"] for r in rows}) == 1 and [r["whole"] for r in rows] == [True, False, False, False] * 2


def plain_ngrams(text):
    """Bucket numbers of the n-grams of a text, one at a time with Python's numbers."""
    raw = f" {text.lower()} ".encode()
    data = [b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in raw]
    out = []
    for n in language_id.LENGTHS:
        for i in range(len(data) - n + 1):
            gram = data[i : i + n]
            if 0x20 in gram[1:-1] or gram[0] == gram[-1] == 0x20:
                continue  # a space stands at one end only
            value = sum(b << 8 * k for k, b in enumerate(gram))
            value = (value ^ n * 0x9E3779B1 & 0xFFFFFFFF) * 0x85EBCA6B % 2**32
            value ^= value >> 15
            out.append((value * 0xC2B2AE35 % 2**32) >> (32 - (language_id.BUCKETS.bit_length() - 1)))
    return out


def test_probabilities_equal_a_forward_pass():
    rng = np.random.default_rng(1)
    model = language_id.Model(("de", "en", "fr"), rng.normal(0, 1, (language_id.BUCKETS, 3)).astype(np.float32), 0.7, 0.0)
    for text in ("the river", "Straße über glass", "a", "x  y\nz 12", "日本語 text", "word " * 300):
        logits = [sum(float(model.weights[b, k]) for b in plain_ngrams(text)) for k in range(3)]
        found = max(1, len(plain_ngrams(text)))
        e = [math.exp(x / found / 0.7) for x in logits]
        assert np.allclose(model.probabilities(text), [x / sum(e) for x in e])


def test_a_text_goes_to_python_once(documents, awkward, model):
    left = language_id.keep_identified(documents(awkward), model)
    plan = left._jdf.queryExecution().optimizedPlan()
    while "MapInArrow" not in plan.getClass().getName():
        plan = plan.children().head()
    assert plan.child().output().size() == 1
    stay = [r.doc_id for r in language_id.identify_languages(documents(awkward), model).collect() if not r.rejected]
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted(stay, key=repr)


def test_slices_give_free_memory_back(monkeypatch):
    import pyarrow as pa

    from reviewloom.llm import common

    returned = []

    class Pool:
        def release_unused(self):
            returned.append(True)

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    batch = pa.RecordBatch.from_arrays([pa.array([b"abc", None, b"defg", b""], pa.binary())], names=["text"])
    assert [s.num_rows for s in common.slices(iter([batch, batch]), "text", 4)] == [2, 2, 2, 2]
    assert len(returned) == 2
