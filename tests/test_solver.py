"""Rows of the solver, its passes and memory, and how often the experiments read their texts."""

from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.operators import features as X
from reviewloom.operators import logistic, logistic_rows, term_counts
from reviewloom.operators import models as M
from reviewloom.session import BATCH_BYTES


def _packable(rows):
    arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64())))]
    return pa.RecordBatch.from_arrays(arrays, ["label", "weight", "indices", "values"])


def _some_rows(n, width, n_classes, seed=1):
    rng = np.random.default_rng(seed)
    filled = [sorted(rng.choice(width, rng.integers(0, 6) * int(i % 4 > 0), replace=False).tolist()) for i in range(n)]
    return [(int(rng.integers(n_classes)), float(rng.uniform(0.5, 2)), f, rng.normal(size=len(f)).tolist()) for f in filled]


def test_packed_rows_are_bounded_by_their_entries(monkeypatch):
    rows = _some_rows(50, 30, 3)
    rows[20] = (1, 1.0, list(range(30)), [1.0] * 30)  # alone above the bound
    monkeypatch.setattr(logistic_rows, "PACKED_ENTRIES", 12)
    packed = list(logistic_rows.pack([_packable(rows).slice(1)]))
    found = list(logistic_rows._unpack(packed))
    assert all(len(f[3]) <= 12 or len(f[0]) == 1 for f in found) and len(found) > 5
    labels, weights, lengths, indices, values = (np.concatenate([f[i] for f in found]).tolist() for i in range(5))
    assert labels == [r[0] for r in rows[1:]] and weights == [r[1] for r in rows[1:]] and lengths == [len(r[2]) for r in rows[1:]]
    assert indices == [i for r in rows[1:] for i in r[2]] and values == [v for r in rows[1:] for v in r[3]]


@pytest.mark.parametrize("n_classes", [2, 3, 4])
def test_a_pass_is_the_loss_and_its_gradient(n_classes):
    """Rows without entries, first and last ones too, count by the intercepts alone."""
    width, rng = 30, np.random.default_rng(2)
    rows = [(0, 1.0, [], []), *_some_rows(60, width, n_classes), (1, 2.0, [], [])]
    weights, intercepts = rng.normal(size=(n_classes, width)), rng.normal(size=n_classes)
    run = logistic_rows._pass(SimpleNamespace(value=(weights, intercepts)), n_classes)
    (blocks,) = run(logistic_rows.pack([_packable(rows[:1]), _packable(rows)]))
    got = np.concatenate([np.frombuffer(b, float) for b in blocks.column("sums").to_pylist()])
    rows = rows[:1] + rows
    x = np.zeros((len(rows), width))
    for r, (_, _, indices, values) in enumerate(rows):
        x[r, indices] = values
    y, w = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    logits = x @ weights.T + intercepts
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    error = (p - np.eye(n_classes)[y]) * w[:, None]
    expected = [-(w * np.log(p[np.arange(len(y)), y])).sum(), *error.sum(axis=0), *(error.T @ x).ravel()]
    assert got == pytest.approx(expected, abs=1e-10)


def test_solver_rows_are_written_in_small_groups_and_removed(spark):
    """Parquet looks at its buffers every 100 rows unless told: 40 packed rows of 2 MB would be one group."""
    schema = T.StructType([T.StructField(n, T.BinaryType()) for n in logistic_rows._PACKED.names])

    def made(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                cells = [pa.array([np.random.default_rng(i).bytes(400_000)], pa.binary())] * 5
                yield pa.RecordBatch.from_arrays(cells, names=schema.names)

    packed = spark.range(0, 40, 1, 1).mapInArrow(made, schema)
    before = spark.conf.get(BATCH_BYTES)
    with logistic.staged(packed, 3) as rows:
        files = [Path(f.removeprefix("file:")) for f in rows.inputFiles()]
        groups = [pq.ParquetFile(f).metadata.row_group(g) for f in files for g in range(pq.ParquetFile(f).metadata.num_row_groups)]
        assert max(g.total_byte_size for g in groups) < 3 * logistic.AT_ONCE and sum(g.num_rows for g in groups) == 40
        # the least and greatest value of every group would stay in memory until the file ends
        assert all(g.column(c).statistics is None for g in groups for c in range(g.num_columns))
        assert rows.sparkSession.conf.get(BATCH_BYTES) == str(logistic.AT_ONCE) and rows.count() == 40
        assert rows.rdd.getNumPartitions() >= 3
    assert not any(f.exists() for f in files) and spark.conf.get(BATCH_BYTES) == before


def test_words_go_to_the_counting_tasks_in_small_batches(spark, monkeypatch):
    counted = term_counts.count_in_blocks

    def watched(n_max):
        count, limit = counted(n_max), 3 * term_counts.SENT_AT_ONCE

        def run(batches):
            def seen():
                for batch in batches:
                    if batch.get_total_buffer_size() > limit:
                        raise ValueError(f"a batch of {batch.get_total_buffer_size()} bytes")
                    yield batch

            yield from count(seen())

        return run

    monkeypatch.setattr(term_counts, "count_in_blocks", watched)
    df = spark.range(0, 2000, 1, 1).select(F.repeat(F.concat(F.lit("same words w"), F.col("id") % 7, F.lit(" ")), 1000).alias("text"))
    before = spark.conf.get(BATCH_BYTES)
    model = X.fit_features(df, "text", 2)
    assert {"same", "words", "w6", "same words", "words w3"} <= set(X.feature_terms(model)) and spark.conf.get(BATCH_BYTES) == before


def test_steps_remembered_save_passes(monkeypatch):
    rng = np.random.default_rng(3)
    turned = np.linalg.qr(rng.normal(size=(300, 300)))[0]
    hessian = turned * np.concatenate([np.logspace(1, 4, 40), np.ones(260)]) @ turned.T
    bowl = lambda p: (0.5 * p @ hessian @ p, hessian @ p)
    begin = rng.normal(size=300)
    point, training = logistic.minimise(bowl, begin, 1000, 1e-5)
    monkeypatch.setattr(logistic, "MEMORY", 20)
    _, before = logistic.minimise(bowl, begin, 1000, 1e-5)
    assert training.converged and np.abs(point).max() < 1e-4 and training.passes < 0.8 * before.passes


def test_experiments_make_each_text_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        made.add(1)
        return text

    rows = [(i, ("Positive", "Negative", "Neutral")[i % 3], f"good{i % 3} words here {i % 2}") for i in range(30)]
    df = spark.createDataFrame(rows, "review_id int, sentiment string, text string").withColumn("review_title", F.lit("t"))
    train, val = (df.filter(c).withColumn("review_body", counted("text")) for c in ("review_id < 20", "review_id >= 20"))
    results = M.run_experiments(train, val, max_iter=1).collect()
    assert made.value == 2 * len(rows)  # once for each text option
    assert [(r.n_train, r.n_val) for r in results] == [(20, 10)] * 5
