"""Multinomial logistic regression whose passes over the data are few.

Spark's own estimator solves in columns of unit variance. With a penalty on
the unscaled weights that makes rare terms creep: the penalty of a column
divided by its variance spans four orders of magnitude. In the columns as they
are, TF-IDF vectors and a penalty are well conditioned, and the limited-memory
quasi-Newton method, begun with the second derivative of each entry, ends after
some dozens of passes. Each pass is a Spark job over a staged table of packed
sparse rows; the driver gets one sum a pass and holds the weights and a few
directions of their size. The fitted model is Spark ML's.
"""

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.ml.util import Identifiable
from pyspark.sql import DataFrame

from reviewloom.operators.logistic_rows import BLOCK, PACKED, _pass, _squares, _sum_block, pack
from reviewloom.session import BATCH_BYTES, batches_of, drop_table, stage_path

#: Steps the method remembers.
MEMORY = 60
#: Bytes that go to Python at once, and that are written and read of a staged file at once.
AT_ONCE = 4 * 2**20
#: Tasks that add up the blocks of a pass, at most.
SUMMING_TASKS = 5
#: Few rows are some megabytes: Parquet's writer, which looks at its buffers every 100 rows, has to look at each,
#: and may not keep the least and greatest value of each group, whole rows, until the file ends.
ROW_GROUPS = {
    "parquet.block.size": AT_ONCE,
    "parquet.page.size": AT_ONCE,
    "parquet.block.size.row.check.min": 1,
    "parquet.block.size.row.check.max": 1,
    "parquet.page.size.row.check.min": 1,
    "parquet.page.size.row.check.max": 1,
    "parquet.enable.dictionary": "false",
    "parquet.column.statistics.enabled": "false",
}
#: A task has this many entries at least, as long as each core has a task: these take some 20 ms, and the task itself more.
ENTRIES_PER_TASK = 1_000_000


@dataclass(frozen=True)
class Training:
    """How a fit ended: passes over the data, iterations, and the largest entry of the gradient per unit of weight."""

    passes: int
    iterations: int
    gradient: float
    converged: bool


def _total(packed: DataFrame, run, size) -> np.ndarray:
    """The sum of the tasks' vectors. It is taken by block on the executors: the driver gets one vector, however many the tasks are."""
    partial = packed.mapInArrow(run, "block int, sums binary").groupBy("block").applyInArrow(_sum_block, "block int, sums binary")
    found = np.zeros(size)
    for row in partial.collect():
        block = np.frombuffer(row.sums, float)
        found[row.block * BLOCK : row.block * BLOCK + len(block)] = block
    return found


def _evaluator(packed: DataFrame, n_classes, width, penalty, total):
    """The penalised loss and its gradient, per unit of weight, at a point (intercepts, then weights)."""
    sc = packed.sparkSession.sparkContext

    def evaluate(point):
        intercepts, weights = point[:n_classes], point[n_classes:].reshape(n_classes, width)
        shared = sc.broadcast((weights, intercepts))
        found = _total(packed, _pass(shared, n_classes), 1 + len(point))
        shared.destroy()
        loss = found[0] + 0.5 * penalty * (weights**2).sum()
        gradient = found[1:]
        gradient[n_classes:] += penalty * point[n_classes:]
        return loss / total, gradient / total

    return evaluate


def minimise(evaluate, point, max_iter, tol, curvature=1.0):
    """Limited-memory BFGS with halved steps, until no entry of the gradient is over ``tol``.

    ``curvature``: an estimate of the second derivative of each entry. Entries
    differ by orders of magnitude, the more so the more rows there are to one penalty.
    Many steps are remembered, which saves passes, and in single precision, which a
    direction can do with: the point, the loss and the gradient are never rounded.
    """
    loss, gradient = evaluate(point)
    passes, iterations, moves = 1, 0, []
    while np.abs(gradient).max() > tol and iterations < max_iter:
        direction, factors = gradient.copy(), []
        for s, y, r in reversed(moves):
            factors.append(r * (s @ direction))
            direction -= factors[-1] * y
        direction /= curvature
        if moves:
            s, y, _ = moves[-1]
            direction *= (s @ y) / (y @ (y / curvature))
        for (s, y, r), a in zip(moves, reversed(factors), strict=True):
            direction += (a - r * (y @ direction)) * s
        slope = gradient @ direction
        if slope <= 0:  # rounding has spoiled the directions
            moves, direction = [], gradient / curvature
            slope = gradient @ direction
        step = 1.0 if moves else min(1.0, 1.0 / np.abs(direction).max())
        while True:
            new_loss, new_gradient = evaluate(point - step * direction)
            passes += 1
            if new_loss <= loss - 1e-4 * step * slope or step < 1e-12:
                break
            step /= 2
        if step < 1e-12:
            break
        s, y = -step * direction, new_gradient - gradient
        if s @ y > 1e-16:
            moves = [*moves, (s.astype(np.float32), y.astype(np.float32), 1 / (s @ y))][-MEMORY:]
        point, loss, gradient = point + s, new_loss, new_gradient
        iterations += 1
    largest = float(np.abs(gradient).max())
    return point, Training(passes, iterations, largest, largest <= tol)


@contextmanager
def staged(packed: DataFrame, tasks: int) -> Iterator[DataFrame]:
    """Rows by ``pack``, written once and removed in the end.

    They are read in a session of its own: its settings hold for the passes alone,
    of which each is one small job of some ``tasks`` tasks, and fewer that add up.
    """
    spark = packed.sparkSession
    path = stage_path(spark, "solver-rows")
    with batches_of(spark, AT_ONCE):
        packed.write.options(**ROW_GROUPS).parquet(path)
    own = spark.newSession()
    own.conf.set(BATCH_BYTES, str(AT_ONCE))
    own.conf.set("spark.sql.adaptive.enabled", "false")
    own.conf.set("spark.sql.shuffle.partitions", str(max(1, min(SUMMING_TASKS, tasks // 4))))
    own.conf.set("spark.sql.files.minPartitionNum", str(tasks))
    own.conf.set("spark.sql.files.maxPartitionBytes", "1g")
    try:
        yield own.read.schema(packed.schema).parquet(path)
    finally:
        drop_table(spark, path)


def fit(packed: DataFrame, mass, width: int, penalty: float, max_iter: int, tol: float):
    """Weights (class, column), intercepts and the ``Training``. ``packed``: rows by ``pack``, staged; ``mass``: the weight of each class."""
    mass = np.array(mass, float)
    n_classes, total = len(mass), mass.sum()
    evaluate = _evaluator(packed, n_classes, width, penalty, total)
    # classes start with their shares, one without rows with less than any
    start = np.log(mass + 1e-3)
    point = np.concatenate([start - start.mean(), np.zeros(n_classes * width)])
    # the second derivatives at that point
    share = (mass + 1e-3) / (mass + 1e-3).sum()
    spread = share * (1 - share)
    curvature = np.concatenate([spread * total, (np.outer(spread, _total(packed, _squares(width), width)) + penalty).ravel()])
    point, training = minimise(evaluate, point, max_iter, tol, curvature / total)
    return point[n_classes:].reshape(n_classes, width), point[:n_classes], training


def as_model(spark, weights: np.ndarray, intercepts: np.ndarray, **columns) -> LogisticRegressionModel:
    """Spark ML's model of these weights."""
    sc = spark.sparkContext
    n_classes, width = weights.shape
    matrix = _py2java(sc, DenseMatrix(n_classes, width, weights.ravel(order="F")))
    vector = _py2java(sc, Vectors.dense(intercepts))
    uid = Identifiable().uid.replace("Identifiable", "LogisticRegression")
    java = sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(uid, matrix, vector, n_classes, True)
    model = LogisticRegressionModel(java)
    return model._set(**columns)
