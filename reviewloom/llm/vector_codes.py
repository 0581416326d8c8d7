"""Vectors as short codes: one codebook for each of their parts, trained by k-means over integers.

Entries are compared exactly only where bounds leave a doubt. A vector keeps,
for each part, an upper bound of the distance to its entry and a lower bound
for each group of the other entries, all with the round in which they were
taken. The history of the codebooks is kept, so that a bound is corrected by
the net way an entry has gone since that round (the norm of the sum of its
moves), which is never more than the sum of the norms and often far less.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.session import stage

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries that share a lower bound.
GROUP = 16
#: Vectors handled at once in a task.
_BATCH = 4096
#: Bounds are floats: a doubt this small is one.
_SLACK = 1e-6

_CODES = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("code", pa.string()), ("error", pa.int64())])


def integer_vectors(vectors: DataFrame, column="embedding") -> DataFrame:
    """vec_id, label and the integer components ``floor(256 * x)`` of the usable rows, all of one length.

    Rows whose vector is NULL or holds a NULL or non-finite component are
    dropped. Shorter vectors end in zeros: the length is the longest one, made
    a multiple of ``PARTS``. A component so large that a sum of squares could
    leave 64 bits is an error.
    """
    finite = F.forall(column, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    rows = vectors.filter(F.col(column).isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.transform(column, lambda x: F.floor(x.cast("double") * SCALE)).alias("vector"),
    )
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(PARTS, -(-width // PARTS) * PARTS)
    most = int((2**60 / width) ** 0.5)
    small = F.forall("vector", lambda x: F.abs(x) <= most)
    padded = F.concat("vector", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("vector")))
    checked = F.when(small, padded).otherwise(F.raise_error(F.lit(f"a component is beyond {most / SCALE}")).cast("array<long>"))
    return rows.withColumn("vector", checked.cast("array<int>"))


def _parts(column: pa.Array) -> np.ndarray:
    """A list column as an array (vectors, parts, width)."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), PARTS, -1)


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (vectors, entries) of integer vectors."""
    most = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    kind = np.float64 if x.shape[1] * 4.0 * float(most) ** 2 < 2**53 else np.int64  # both exact, the first one faster
    x, entries = x.astype(kind), entries.astype(kind)
    return ((x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)).astype(np.int64)


def groups_of(n_entries: int) -> list[slice]:
    return [slice(start, min(start + GROUP, n_entries)) for start in range(0, n_entries, GROUP)]


class PartState:
    """Entry and bounds of one part of some vectors; ``stamp`` arrays hold the round each bound is from."""

    def __init__(self, entry, upper, upper_stamp, lower, lower_stamp):
        self.entry, self.upper, self.upper_stamp, self.lower, self.lower_stamp = entry, upper, upper_stamp, lower, lower_stamp


def first_scan(x: np.ndarray, entries: np.ndarray) -> PartState:
    """All distances to the first codebook."""
    squared = _distances(x, entries)
    entry = squared.argmin(axis=1)  # the lowest index of equal ones
    at = np.arange(len(x))
    distance = np.sqrt(squared.astype(np.float64))
    upper = distance[at, entry]
    distance[at, entry] = np.inf
    lower = np.stack([distance[:, g].min(axis=1) for g in groups_of(len(entries))], axis=1)
    zero = np.zeros(lower.shape, np.uint8)
    return PartState(entry, upper, zero[:, 0].copy(), lower, zero)


def rescan(x: np.ndarray, history: list[np.ndarray], state: PartState) -> int:
    """Move ``state`` to the newest codebook of ``history``; the number of groups that had to be scanned.

    ``net[r][j]`` is how far entry j is from where it was in round r.
    """
    now, entries = len(history) - 1, history[-1]
    groups, at = groups_of(len(entries)), np.arange(len(x))
    net = np.stack([np.sqrt(((entries - then).astype(np.float64) ** 2).sum(axis=1)) for then in history])
    group_net = np.stack([net[:, g].max(axis=1) for g in groups], axis=1)
    upper = state.upper + net[state.upper_stamp, state.entry]
    lower = state.lower - group_net[state.lower_stamp, np.arange(len(groups))]
    doubt = (lower <= upper[:, None] * (1 + _SLACK) + _SLACK).any(axis=1)
    # the bound of the own entry first: one distance
    rows = np.flatnonzero(doubt)
    own = np.zeros(len(x))
    own[rows] = np.sqrt(((x[rows].astype(np.int64) - entries[state.entry[rows]]) ** 2).sum(axis=1).astype(np.float64))
    upper[rows] = state.upper[rows] = own[rows]
    state.upper_stamp[rows] = now
    open_ = doubt[:, None] & (lower <= upper[:, None] * (1 + _SLACK) + _SLACK)
    scanned = int(open_.sum())
    if not scanned:
        return 0
    before = state.entry.copy()
    own_squared = np.full(len(x), np.iinfo(np.int64).max)
    own_squared[rows] = ((x[rows].astype(np.int64) - entries[before[rows]]) ** 2).sum(axis=1)
    best, best_entry = own_squared.copy(), before.copy()
    found = {}
    for k, g in enumerate(groups):
        hit = np.flatnonzero(open_[:, k])
        if not len(hit):
            continue
        squared = _distances(x[hit], entries[g])
        found[k] = hit, squared
        nearest = squared.argmin(axis=1)
        value, entry = squared[np.arange(len(hit)), nearest], nearest + g.start
        better = (value < best[hit]) | ((value == best[hit]) & (entry < best_entry[hit]))
        best[hit[better]], best_entry[hit[better]] = value[better], entry[better]
    state.entry = best_entry
    state.upper[rows] = np.sqrt(best[rows].astype(np.float64))
    for k, (hit, squared) in found.items():
        distance = np.sqrt(squared.astype(np.float64))
        inside = (best_entry[hit] >= groups[k].start) & (best_entry[hit] < groups[k].stop)
        distance[np.flatnonzero(inside), best_entry[hit][inside] - groups[k].start] = np.inf
        state.lower[hit, k], state.lower_stamp[hit, k] = distance.min(axis=1), now
    # an entry that was left is one of the others now; where its group was scanned the minimum holds it already
    left = np.flatnonzero(best_entry != before)
    k = before[left] // GROUP
    unscanned = ~open_[left, k]
    left, k = left[unscanned], k[unscanned]
    state.lower[left, k], state.lower_stamp[left, k] = np.minimum(lower[left, k], own[left]), now
    return scanned


def _fixed(array: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(array).reshape(len(array), -1).view(np.uint8)
    return pa.array([row.tobytes() for row in raw], pa.binary())


def _state_batch(batch, states) -> pa.RecordBatch:
    """Bounds are kept as 32-bit floats, rounded away from the truth."""
    upper = np.stack([s.upper for s in states], 1).astype(np.float32)
    lower = np.stack([s.lower for s in states], 1).astype(np.float32)
    columns = {
        "vec_id": batch.column("vec_id"),
        "label": batch.column("label"),
        "vector": batch.column("vector"),
        "entry": _fixed(np.stack([s.entry for s in states], 1).astype(np.uint8)),
        "upper": _fixed(np.nextafter(upper, np.float32(np.inf))),
        "upper_stamp": _fixed(np.stack([s.upper_stamp for s in states], 1)),
        "lower": _fixed(np.nextafter(lower, np.float32(-np.inf))),
        "lower_stamp": _fixed(np.stack([s.lower_stamp for s in states], 1)),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _array(batch, name, kind) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(batch.num_rows, PARTS, -1)


def _states(batch) -> list[PartState]:
    entry, upper = _array(batch, "entry", np.uint8)[:, :, 0].astype(np.int64), _array(batch, "upper", np.float32)[:, :, 0]
    stamp = _array(batch, "upper_stamp", np.uint8)[:, :, 0]
    lower, lower_stamp = _array(batch, "lower", np.float32), _array(batch, "lower_stamp", np.uint8)
    return [
        PartState(entry[:, p].copy(), upper[:, p].astype(float), stamp[:, p].copy(), lower[:, p].astype(float), lower_stamp[:, p].copy())
        for p in range(PARTS)
    ]


def _pieces(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, _BATCH):
            yield batch.slice(start, _BATCH)


def _advance(batch, history) -> tuple[np.ndarray, list[PartState]]:
    """The parts of a batch and their states under the newest codebooks."""
    x = _parts(batch.column("vector"))
    if len(history) == 1:
        return x, [first_scan(x[:, p], history[0][p]) for p in range(PARTS)]
    states = _states(batch)
    for p, state in enumerate(states):
        rescan(x[:, p], [books[p] for books in history], state)
    return x, states


def _assign(history):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            yield _state_batch(batch, _advance(batch, history)[1])

    return run


def _encode(history):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            x, states = _advance(batch, history)
            entry = np.stack([s.entry for s in states], 1)
            chosen = np.stack([history[-1][p][entry[:, p]] for p in range(PARTS)], 1)
            error = ((x.astype(np.int64) - chosen) ** 2).sum(axis=(1, 2))
            code = [row.tobytes().hex() for row in entry.astype(np.uint8)]
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(code), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, schema=_CODES)

    return run


def _partial_sums(n_entries):
    """One row for each entry that a task has met: its count and sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = sums = None
        for batch in _pieces(batches):
            x, entry = _parts(batch.column("vector")).astype(np.int64), _array(batch, "entry", np.uint8)[:, :, 0]
            if count is None:
                count, sums = np.zeros((PARTS, n_entries), np.int64), np.zeros((PARTS, n_entries, x.shape[2]), np.int64)
            for p in range(PARTS):
                count[p] += np.bincount(entry[:, p], minlength=n_entries)
                np.add.at(sums[p], entry[:, p], x[:, p])
        if count is not None:
            part, number = np.nonzero(count)
            columns = [part, number, count[part, number], pa.array(list(sums[part, number]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "entry", "n", "sums"])

    return run


def _next_codebooks(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry replaced by the mean of its parts, rounded down; the driver gets one row for each entry."""
    width = books.shape[2]
    partial = state.select("vector", "entry").mapInArrow(_partial_sums(books.shape[1]), "part long, entry long, n long, sums array<long>")
    means = partial.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums")
    )
    books = books.copy()
    for row in means.toLocalIterator():
        books[row.part, row.entry] = np.array(row.sums, np.int64) // row.n
    return books


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def train_codebooks(vectors: DataFrame, rounds=ROUNDS, entries=ENTRIES):
    """The history of the codebooks, one array (part, entry, width) a round, and the vectors with their bounds.

    ``vectors`` comes from ``integer_vectors``, staged. The first codebooks are the parts
    of the first ``entries`` vectors (at most 256, by id, then components; fewer where there are fewer).
    """
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    if not first:
        return [], vectors
    history = [np.array([r.vector for r in first], np.int64).reshape(len(first), PARTS, -1).transpose(1, 0, 2).copy()]
    kept = T.StructType(vectors.schema.fields + [T.StructField(c, T.BinaryType()) for c in ("entry", "upper", "upper_stamp", "lower", "lower_stamp")])
    for _ in range(rounds):
        vectors = stage(vectors.mapInArrow(_assign(history), kept), "bounded-vectors")
        history.append(_next_codebooks(vectors, history[-1]))
    return history, vectors


def compress(vectors: DataFrame, column="embedding", rounds=ROUNDS, entries=ENTRIES) -> DataFrame:
    """vec_id, code (hex, a byte for each part), error, label_error and codebooks_sha256 of the usable rows.

    See ``integer_vectors`` for the rows that are dropped. Repeated rows and
    ids are coded each. Rows without an id come after all others. An empty
    table gives no row; other columns are not read. The driver holds
    ``rounds + 1`` codebooks of at most ``entries`` vectors.
    """
    usable = stage(integer_vectors(vectors, column), "integer-vectors")
    history, bounded = train_codebooks(usable, rounds, entries)
    spark = vectors.sparkSession
    if not history:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = stage(bounded.mapInArrow(_encode(history), "vec_id long, label long, code string, error long"), "codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(history[-1])).alias("codebooks_sha256")
    )
